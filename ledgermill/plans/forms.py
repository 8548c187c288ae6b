"""Queries of the form extractors, their quality and the scalar functions, on composed texts that take every branch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermill.functions import columns as C
from ledgermill.functions import json as J
from ledgermill.operators import forms as X
from ledgermill.operators import quality as Q
from ledgermill.sources.tables import saved

from .registry import cases

YEAR = 2025


def _told(*names: str):
    return lambda *values: dict(zip(names, values, strict=True))


def _listed(of: Column, *fields: str) -> Column:
    """Structs of an array as text: fields after each other, nulls as a dash."""
    return F.array_join(F.transform(of, lambda x: F.concat_ws("|", *[F.coalesce(x[f].cast("string"), F.lit("-")) for f in fields])), ";")


def _with(docs: DataFrame, **columns: Column) -> DataFrame:
    return X.with_lines(docs).withColumn("v", X.detect_version(F.col("text"))).select("doc_id", *[c.alias(n) for n, c in columns.items()])



_v = _told("profile", "family", "year_hint", "signal_count")
V1, V2, V3 = (X.FAMILIES[x] for x in ("v1", "v2", "v3"))


@cases([
    ("PROGRAMA/ATIVIDADES DE PD&I - 1", _v("v3_early", V3, None, "1")), ("Programa/Atividades de PD&I -2\nITEM/TÍTULO DO PROJETO DE PD&I", _v("v3_late", V3, None, "2")),
    ("Dados da Empresa\nReceita Operacional  Bruta", _v("v3_late", V3, None, "2")), ("dados da empresa\nAno Base: 2024", _v("v3_late", V3, "2024", "2")), ("Dados da Empresa\nMRL 3", _v("v3_late", V3, None, "2")),
    ("Dados da Empresa\nJustifique o nível de maturidade", _v("v3_late", V3, None, "2")), ("Recibo de Entrega", _v("v2_early", V2, None, "1")), ("Recibo de Entrega\n[item1]", _v("v2_late", V2, None, "2")),
    ("Recibo de entrega\nAno Base: 2022", _v("v2_late", V2, "2022", "2")), ("Dados Pessoa Jurídica {k}", _v("v1_2018", V1, None, "1")), ("(O) Sim", _v("v1_2017", V1, None, "1")), ("( x ) Sim", _v("v2_early", V2, None, "0")),
    ("Ano base 2.017", _v("v1_2017", V1, "2017", "1")), ("ano base - 2018", _v("v1_2018", V1, "2018", "1")), ("Ano Base 2021", _v("v2_early", V2, "2021", "1")), ("Ano Base: 2022", _v("v2_late", V2, "2022", "1")),
    ("Ano Base: 2023", _v("v3_early", V3, "2023", "1")), ("Ano Base: 2031", _v("v3_late", V3, "2031", "1")), (None, _v("v2_early", V2, None, "0")), ("3.1.2. Itens de dispêndio, recursos humanos", _v("v2_early", V2, None, "3")),
])
def form_version(docs):
    v = X.detect_version(F.col("text"))
    return docs.select("doc_id", v.alias("v")).select("doc_id", *(F.col(f"v.{n}").alias(n) for n in ("profile", "family", "year_hint", "signal_count")))


_c = _told("company_id", "legal_name", "year")


@cases([
    ("CNPJ: 11.222.333/0001-81\nRazão Social: Acme {k} Ltda\nAno Base: 2021", _c("11222333000181", "Acme {k} Ltda", "2021")),
    ("n. 12345678901234 e 99888777000166\nRAZAO SOCIAL\n\n  Fornos {k}\n", _c("12345678901234", "Fornos {k}", None)),
    ("Razão Social\nCNPJ\nfim de 2019 e 2023, 2090", _c(None, None, "2023")), ("Razão social: CNPJ 1\nNome {k}", _c(None, "Nome {k}", None)), (None, _c(None, None, None)),
    ("123456789012345 ano-calendario 2018 e 2024", _c(None, None, "2018")),
])
def form_company(docs):
    found = X.company_of(F.col("text"), F.col("lines"))
    return _with(docs, company_id=found["company_id"], legal_name=found["legal_name"], year=C.fiscal_year(F.col("text"), YEAR, found["legal_name"]))


@cases([
    ("antes: 1\nDados da Empresa\nRazão Social: Acme {k}\nCNPJ:\n11\nNúmero: 5\nNúmero do lote: 9\nCNAE: 62\nBairro:\nCentro\nMunicípio: Lá\nCód. Postal: 1\nDados do Remetente\nSigla: X", {"fields": "bairro=Centro,cnae=62,cnpj=11,cod_postal=1,municipio=Lá,numero=5,razao_social=Acme {k}"}),
    ("Dados Pessoa Jurídica\n1. Identificação da Empresa\nLogradouro: Rua {k}\nLogradouro: Rua B{k}\nBairro:\nTipo: x", {"fields": "logradouro=Rua B{k}"}), ("Razão Social: Acme", {"fields": ""}), (None, {"fields": ""}),
])
def form_registry(docs):
    pairs = F.array_sort(F.transform(F.map_entries("m"), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return _with(docs, m=X.registry_of(F.col("filled"))).select("doc_id", F.array_join(pairs, ",").alias("fields"))


@cases([
    ("Identificação/Características da Empresa\nQual é o tipo de empresa?\n( X ) Pública\n( O ) Privada {k}\n2.1 Número total de funcionários com\nvínculo na empresa?\nsem dado\n{k}\nReceita Líquida: R$ 5,00\nA forma de apuração do\nIRPJ e da CSLL?\nLucro real", {"qa": "4", "fields": "company_type=Privada {k},employee_count_with_contract={k},irpj_csll_apportionment=Lucro real,net_revenue=R$ 5,00"}),
    ("1. Identificação da Empresa\n1.2. Situação da empresa\nAtiva {k}\nEstrutura organizacional de P&D?\nlinha um\nPágina: 3\nlinha dois\n3. Programa/Atividades de PD&I\nReceita líquida: 9", {"qa": "2", "fields": "company_status=Ativa {k},rnd_organizational_structure=linha um linha dois"}),
    ("Qual é o tipo de empresa?\nx", {"qa": "0", "fields": ""}), (None, {"qa": "0", "fields": ""}),
    ("Identificação / Características da empresa\nReceita Operacional Bruta Anual?\ntexto\n1.234,56\nTotal de funcionários com vínculo?\n12 pessoas\n34\nFechou com prejuízo fiscal?\n( o ) Não", {"qa": "3", "fields": "closed_year_with_tax_loss=Não,employee_count_with_contract=34,gross_operational_revenue=1.234,56"}),
])
def form_identification(docs):
    found = X.identification_of(X.with_lines(docs))
    pairs = F.array_sort(F.transform(F.map_entries("identification"), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return found.select("doc_id", F.size("qa").alias("qa"), F.array_join(pairs, ",").alias("fields"))


_r = _told("sender_name", "sender_cpf", "authenticity_code", "expedition_at")


@cases([
    ("Dados do Remetente\nNome:\nAna {k}\nCPF: 111.222.333-44\nExpedido em: 03/04/2024\nCódigo de Autenticidade: ABCD1234-EF56\nNome: outro", _r("Ana {k}", "11122233344", "ABCD1234-EF56", None)),
    ("Dados do Remetente\nCPF -\n\n123\nExpedição: 03/04/2024 às 10h\nFormulario do ano de referencia\nNome: fora", _r(None, "123", None, "03/04/2024 às 10h")),
    ("Dados do Remetente\nCPF: 5\nFormulário do ano de referência\nNome: dentro {k}", _r("dentro {k}", "5", None, None)),
    ("Recibo de Entrega\nNome: Rui {k} .\nCPF: x\nCodigo de autenticidade - 12345678901234567890123", _r("Rui {k}", None, "12345678901234567890123", None)),
    ("Dados do Remetente\nNome: Eva {k}\nCódigo de Autenticidade: ZZ\nExpedição: 03/04/2024\nNome: outra", _r("Eva {k}", None, "ZZ", "03/04/2024")),
    ("Dados do Remetente\nNome: Eva\nCPF: 1\nDados do Remetente\nNome: Lia {k}\nCODIGO DE AUTENTICIDADE: YY\nExpedição: 03/04/2024", _r("Lia {k}", None, "YY", None)),
    ("Nome: Ana\nCPF: 1", _r(None, None, None, None)), (None, _r(None, None, None, None)),
])
def form_receipt(docs):
    found = X.receipt_of(F.col("lines"))
    return _with(docs, r=found).select("doc_id", "r.*")


_s = _told("found", "project_count", "declared_total", "listed")


@cases([
    ("1 antes R$ 5,00\nPrograma/Atividades de PD&I\nItem Nome da atividade Valor\n1 Forno {k}; calor, aço R$ 1.000,00\n2 Motor\n3 Bomba R$ 250.000\nTotal R$ 9,00\nTotal R$ 251.000,00\nPrograma/Atividades de PD&I - 1\n4 fora R$ 1,00", _s("true", "3", "251000.00", "1|Forno {k}|1000.00;2|Motor|-;3|Bomba|250000.00")),
    ("Programa/Atividades de PD&I\n1 sem cabeça R$ 5,00\nTOTAL R$ 5,00", _s("false", "0", None, "")), ("9 texto R$ 5,00", _s("false", "0", None, "")), (None, _s("false", "0", None, "")),
    ("PROGRAMA/ATIVIDADES DE PD&I\nNome do item\nTotal geral: R$ 7,5", _s("true", "0", "7.50", "")),
    ("Programa/Atividades de PD&I - 1\nPrograma/Atividades de PD&I\nItem Nome\n1 Forno R$ 5,00\nTotal R$ 5,00", _s("false", "0", None, "")),
])
def form_summary(docs):
    return _with(docs, t=X.summary_table(F.col("filled"))).select("doc_id", "t.found", "t.project_count", "t.declared_total", _listed(F.col("t.rows"), "item", "title", "total").alias("listed"))


PROJECT_FIELDS = ("item_number", "title", "description", "category", "pb_pa_or_de", "nature", "is_continuous", "knowledge_area", "specific_area", "methodology")


@cases([
    ("Programa/Atividades de PD&I - 1\nItem/Título do Projeto de PD&I\n7. Forno {k}\nDescrição do Projeto\num\nPágina: 2\ndois\nCategoria predominante\nPesquisa aplicada\nO projeto é contínuo?\nNão\nNatureza\nProcesso novo\nÁrea do projeto\nEngenharia\nEspecificar área de conhecimento\nTermo\nMetodologia\nmedir\nPrograma/Atividades de PD&I - 2\nItem/Nome da Atividade de PD&I\nMotor\nPB, PA ou DE\n(DE)", {"listed": "7|Forno {k}|um dois|PESQUISA_APLICADA|2|PROCESSO|false|Engenharia|Termo|medir;2|Motor|-|DESENVOLVIMENTO_EXPERIMENTAL|3|-|-|-|-|-"}),
    ("Recibo de Entrega\n3.1.1. [Item 2] Nome da atividade de PD&I\nBeta {k}\n3.1.2. PB, PA ou DE\nPesquisa básica\n3.1.3. [Item 1] Natureza\n( X ) Produto\n( O ) Serviço\n3.1.4. [Item 1] Descrição do projeto\num\ndois\n3.1.5. A atividade é contínua?\n( O ) Sim\n3.1.6. [Item 1] Metodologia\nmedir", {"listed": "1|Projeto 1|um dois|-|-|SERVICO|-|-|-|medir;2|Beta {k}|-|PESQUISA_BASICA|1|-|true|-|-|-"}),
    ("Recibo de Entrega\nNome da atividade de PD&I", {"listed": "1|Projeto 1||-|-|-|-|-|-|-"}), ("nada", {"listed": ""}), (None, {"listed": ""}),
    ("Recibo de entrega\nPrograma/Atividades de PD&I - 1", {"listed": "1|Projeto 1|-|-|-|-|-|-|-|-"}),
])
def form_projects(docs):
    return _with(docs, p=X.projects_of(F.col("text"), F.col("filled"), F.col("v.family"))).select("doc_id", _listed(F.col("p"), *PROJECT_FIELDS).alias("listed"))


DETAIL_FIELDS = ("trl_initial", "mrl_initial", "strl_initial", "trl_final", "mrl_final", "strl_final", "financing_own_pct", "financing_external_pct", "economic_result_objective", "economic_result_obtained", "innovation_result_obtained", "aligns_public_policy", "public_policy_ref", "trl_justification")
_B = "Programa/Atividades de PD&I - 1\n"


@cases([
    (_B + "Inicial:\nTRL 4\nMRL 3\nSTRL 2\nFinal: TRL 7 / STRL 5", {"listed": "4|3|2|7|-|5|-|-|-|-|-|-|-|-"}), (_B + "Inicial: STRL 2", {"listed": "-|-|2|-|-|-|-|-|-|-|-|-|-|-"}),
    (_B + "Fontes de financiamento\nRecursos próprios %: 70,5\nFinanciamentos % 29", {"listed": "-|-|-|-|-|-|70.5|29.0|-|-|-|-|-|-"}),
    (_B + "Resultado econômico\nObjetivo do projeto:\nvender {k}\nNo ano-base:\nvendeu\nResultado de inovação\nnovo forno", {"listed": "-|-|-|-|-|-|-|-|vender {k}|vendeu|novo forno|-|-|-"}),
    (_B + "Alinham com as políticas públicas nacionais\nSim, à saúde\nItens de dispêndio\nJustifique a maturidade\nporque {k}", {"listed": "-|-|-|-|-|-|-|-|-|-|-|true|Sim|porque {k}"}),
    (_B + "Alinham com as políticas públicas nacionais\nPlano {k}", {"listed": "-|-|-|-|-|-|-|-|-|-|-|-|Plano {k}|-"}),
])
def form_project_details(docs):
    return _with(docs, p=X.block_projects(F.col("filled"))).select("doc_id", _listed(F.col("p"), *DETAIL_FIELDS).alias("listed"))


_H = "Recibo de Entrega\n3.1.2.1.1. [Item 2] Relação de Recursos Humanos\nItem 1\nCPF 111.222.333-44\nNome João {k}\nTitulação Mestre\nFunção Chefe\nTotal horas ano 1.200\nDedicação Exclusiva\nValor (R$): 1.234,56\nItem 2\nNome Bia\nItem 3\nobs\n3.1.2.1.2. Relação de recursos humanos\nItem 1\nNome Eva\nNenhum registro adicionado\nItem 9\nNome Fora"
STAFF = ("project_index", "cpf", "name", "role", "qualification", "annual_hours", "dedication_type", "dedication_pct", "annual_amount")


@cases([
    (_H, {"listed": "2|11122233344|João {k}|Chefe|Mestre|1|Exclusiva|100|1234.56;2|-|Bia|-|-|-|-|-|-;2|-|Eva|-|-|-|-|-|-"}),
    ("Dados Pessoa Jurídica\n3.1.3.1.1. Recursos Humanos do projeto\nItem 1\nNome Ana {k}\nDedicação Parcial\nValor total (R$) R$ 10", {"listed": "3|-|Ana {k}|-|-|-|Parcial|-|10.00"}),
    ("Dados da Empresa\nPrograma/Atividades de PD&I - 4\nRelação de Recursos Humanos\nCPF NOME TITULAÇÃO\n111.222.333-44 João Mestre Engenheiro Exclusiva 1200\nR$ 12.345,67\n222.333.444-55 Bia Lima Parcial 800 R$ 1.000,00\nFontes de financiamento\n333.444.555-66 Fora", {"listed": "4|11122233344|João|Engenheiro|Mestre|1200|EXCLUSIVA|100|12345.67;4|22233344455|Bia Lima|-|-|800|PARCIAL|-|1000.00"}),
    ("Recibo de Entrega", {"listed": ""}), (None, {"listed": ""}),
])
def form_staff(docs):
    return _with(docs, p=X.staff_of(F.col("filled"), F.col("v.family"))).select("doc_id", _listed(F.col("p"), *STAFF).alias("listed"))


_E = "Programa/Atividades de PD&I - 3\nantes R$ 1,00\nItens de Dispêndio\nServiços técnicos R$ 100,00\nPeças {k}\nR$ 50,00\nSoma R$ 150,00\nA R$ 60,00\nB: R$ 90,00\nA R$ 60,00\nViagens R$ 7,00\nTotal R$ 999,00\nnada R$ 0,00\nRecursos humanos envolvidos no projeto\nfora R$ 5,00"


@cases([
    ("Dados da Empresa\n" + _E, {"listed": "3|Serviços técnicos|100.00|-|-|-|-;3|Peças {k}|50.00|-|-|-|-;3|A|60.00|-|-|-|-;3|B|90.00|-|-|-|-"}),
    ("Recibo de Entrega\n3.1.2.1.2. [Item 2] Serviços de apoio técnico\nItem 1\nCNPJ 11.222.333/0001-81\nNome Fornecedor {k}\nValor total (R$): R$ 500,00\nCaracterizar o serviço: teste\nSituação: Concluído\nItem 2\nValor (R$) R$ 20,00\nDescrição:\nna linha\nItem 3\nNome sem valor\n3.1.4.1.3. Material de consumo\nItem 1\nValor (R$) R$ 1,00", {"listed": "2|Serviços de apoio técnico|500.00|teste|11.222.333/0001-81|Fornecedor {k}|Concluído;2|Serviços de apoio técnico|20.00|na linha|-|-|-"}),
    ("Recibo de Entrega\n3.1.2.1.2. Serviços de apoio técnico\nItem 1\nDescrição:\nCNPJ 11.222\nNome Fornecedor {k}\nValor (R$) R$ 20,00\nItem 2\nValor (R$) R$ 3,00\nDescrição:\nItem 9\nNome Outro", {"listed": "2|Serviços de apoio técnico|20.00|CNPJ 11.222|-|Fornecedor {k}|-;2|Serviços de apoio técnico|3.00|Item 9|-|Outro|-"}),
    ("Dados da Empresa", {"listed": ""}), (None, {"listed": ""}),
])
def form_expenses(docs):
    read = X.with_lines(docs).withColumn("v", X.detect_version(F.col("text")))
    return X.with_expenses(read, "p", F.col("filled"), F.col("v.family")).select("doc_id", _listed(F.col("p"), *X.EXPENSE).alias("listed"))


@cases([
    ("Programa/Atividades de PD&I - 2\nItens de dispêndio\nEquipamentos nacionais:\nR$ 30,00\nEquipamentos importados {k}\nR$ 4.000,50\nEquipamentos nacionais\nsem valor", {"listed": "2|NACIONAL|Equipamentos nacionais|30.00;2|IMPORTADO|Equipamentos importados {k}|4000.50"}),
    ("Equipamentos nacionais\nR$ 5,00", {"listed": ""}), (None, {"listed": ""}),
])
def form_equipment(docs):
    return _with(docs, p=X.equipment_of(F.col("filled"))).select("doc_id", _listed(F.col("p"), "project_index", "origin", "description", "amount").alias("listed"))


@cases([
    ("Gerado em 1", {"kinds": "noise"}), ("Metodologia", {"kinds": "label"}), ("3.1.2. x", {"kinds": "heading"}), ("PROGRAMA/ATIVIDADES DE PD&I - 2", {"kinds": "block"}), ("texto {k}", {"kinds": ""}),
    ("3.1. Palavras-chave\nPágina de 2", {"kinds": "label+heading,noise"}), (None, {"kinds": None}),
])
def form_line_kinds(docs):
    kinds = F.transform("filled", lambda x: F.concat_ws("+", *[F.when(x[k], k) for k in ("noise", "label", "heading", "block")]))
    return _with(docs, kinds=F.array_join(kinds, ","))


V3_FORM = (
    "Ano Base: 2024\nDados da Empresa\nRazão Social: Acme {k}\nCNPJ: 11.222.333/0001-81\nDados do Remetente\nNome: Ana\nCPF: 1\nExpedição: 01/02/2025\nCódigo de Autenticidade: ABCD1234-EF56-7\n"
    "Programa/Atividades de PD&I\nItem Nome Valor\n1 Forno R$ 100,00\nTotal R$ 100,00\nPrograma/Atividades de PD&I - 1\nItem/Título do Projeto de PD&I\nForno\nDescrição do projeto\nd\nElemento tecnologicamente novo\ne\n"
    "Categoria predominante\nPesquisa básica\nMetodologia\nm\nInicial: TRL 3\nFinal: TRL 5\nJustifique a maturidade\nporque\nItens de dispêndio\nPeças R$ 104,00\nEquipamentos nacionais\nR$ 5,00\nRecursos humanos envolvidos no projeto\n"
    "Relação de Recursos Humanos\n111.222.333-44 João Mestre Chefe 1200 R$ 9,00"
)
V2_FORM = "Recibo de Entrega\nNome: Rui\nCPF: 2\nCódigo de autenticidade: 12345678901234567890123\n11222333000182 ano base 2020\n3.1.1. [Item 1] Nome da atividade de PD&I\nAlfa {k}\n3.1.2. [Item 1] PB, PA ou DE\n(PB)"


@cases([
    (V3_FORM, {"company": "Acme {k}", "projects": "Forno/1/2/1"}), (V2_FORM, {"company": None, "projects": "Alfa {k}/0/0/0"}), (None, {"company": None, "projects": ""}),
])
def form_extraction(docs):
    told = F.transform("projects", lambda p: F.concat_ws("/", p["project"]["title"], F.size(p["human_resources"]), F.size(p["expenses"]), F.size(p["equipment"])))
    return X.extract(docs, YEAR).select("doc_id", F.col("company.legal_name").alias("company"), F.array_join(told, ";").alias("projects"))


_q = _told("profile", "band", "review", "missing", "checks", "valid", "said", "overall", "first", "queued")


@cases([
    (V3_FORM, _q("v3_late", "HIGH", "false", "", "true,true,true,true,true,true,true,true,true", "true", "HIGH", "0.9400", None, None)),
    (V2_FORM, _q("v2_late", "LOW", "true", "projects.human_resources,projects.expenses,projects.economic_result_obtained", "false,true,true,false,null,null,true,false,true", "true", "MEDIUM", "0.5686", "projects.economic_result_obtained", "3")),
    (V2_FORM.replace("[Item 1] ", ""), _q("v2_early", "MEDIUM", "true", "projects.innovative_element,projects.human_resources", "false,true,true,null,null,null,true,false,true", "true", "MEDIUM", "0.6283", "projects.human_resources", None)),
    ("nada n{k}", _q("v2_early", "LOW", "true", "cnpj,fiscal_year,submission_receipt.sender_name,submission_receipt.sender_cpf,submission_receipt.authenticity_code,projects.title,projects.category,projects.innovative_element,projects.human_resources", "false,false,false,null,null,null,false,false,false", "false", "LOW", "0.0000", "cnpj", "9")),
    ("Dados Pessoa Jurídica\n11.222.333/0001-81 ano base 2018", _q("v1_2018", "LOW", "true", "projects.title,projects.category,projects.innovative_element", "true,true,null,null,null,null,null,null,false", "false", "MEDIUM", "0.4062", "projects.category", "3")),
])
def form_quality(docs):
    scores = saved(Q.scored(saved(X.extract(docs, YEAR), "extracted")), "scored")
    checks = F.concat_ws(",", *[F.coalesce(F.col(f"cv_results.`CV-0{i}`").cast("string"), F.lit("null")) for i in range(1, 10)])
    queue = Q.ai_queue(scores).select("doc_id", F.size("fields").alias("queued"))
    return scores.join(queue, "doc_id", "left").select(
        "doc_id", "profile", F.col("score_band").alias("band"), F.col("needs_ai").alias("review"), F.array_join("missing_mandatory", ",").alias("missing"), checks.alias("checks"),
        F.col("validation.valid").alias("valid"), F.col("validation.confidence").alias("said"), F.round("overall", 4).cast("decimal(6,4)").alias("overall"), F.get("ai_candidates", F.lit(0))["field"].alias("first"), "queued",
    )


# scalar functions ---------------------------------------------------------------------------------------------------------------------

_m = _told("marked", "last", "loose")


@cases([
    ("x R$ 1.234,56 R$ 2,00", _m("1234.56", "1234.56", None)), ("r$250.000", _m("250000.00", "250000.00", "250.00")), ("R$ 1.234,5", _m("1234.50", "1234.50", "1234.50")), ("total 77", _m(None, "77.00", "77.00")),
    ("R$ 1,2,3", _m(None, None, None)), ("-5,10", _m(None, "5.10", "-5.10")), ("{k}", _m(None, "{k}.00", "{k}.00")), (None, _m(None, None, None)), ("R$", _m(None, None, None)),
])
def money_forms(docs):
    t = F.col("text")
    return docs.select("doc_id", C.money_in_text(t).alias("marked"), C.money_or_last_number(t).alias("last"), C.loose_money(t).alias("loose"))


_d = _told("loose", "br", "or_last", "folder", "shown")


@cases([
    ("03/04/2024", _d("2024-04-03", "2024-04-03", "2024", "2024-01-30", "03/04/2024")), ("03-04-2024", _d("2024-04-03", None, "2024", "2024-01-30", "03/04/2024")),
    ("3/4/2024 10:00", _d("2024-04-03", None, "2024", "2024-01-30", "03/04/2024")), ("2024-05-06T10:00:00Z", _d("2024-05-06", None, "2024", "2024-01-30", "06/05/2024")),
    ("em 2019, talvez", _d("2019-01-01", None, "2019", "2024-01-30", "01/01/2019")), ("99/99/2020", _d("2020-01-01", None, "2020", "2024-01-30", "01/01/2020")), ("nada n{k}", _d(None, None, "2023", "2024-01-30", None)), (None, _d(None, None, "2023", "2024-01-30", None)),
])
def date_forms(docs):
    t, at = F.col("text"), F.expr("TIMESTAMP_NTZ'2024-01-30 12:00:00'")
    return docs.select("doc_id", C.loose_date(t).alias("loose"), C.br_date(t).alias("br"), C.year_or_last(F.year(C.loose_date(t)), at).alias("or_last"), C.date_folder(at).alias("folder"), C.date_shown(C.loose_date(t)).alias("shown"))


_n = _told("file", "stored", "entity", "initials", "activity", "lower")


@cases([
    (" a/b:c  d ", _n("a_b_c d.pdf", "_a_b_c__d_", "false", "AD", None, "a/b:c d")), ("Nota.PDF", _n("Nota.PDF", "Nota.PDF", "false", "N", None, "nota.pdf")), ("", _n("arquivo.pdf", "", "false", "", None, "")), (None, _n("arquivo.pdf", None, "false", None, None, "")),
    ("Construtora Ágil", _n("Construtora Ágil.pdf", "Construtora__gil", "true", "CÁ", None, "construtora agil")), ("Fundação X S.A.", _n("Fundação X S.A..pdf", "Funda__o_X_S.A.", "true", "FX", None, "fundacao x s.a.")),
    ("Mesa Sabor", _n("Mesa Sabor.pdf", "Mesa_Sabor", "false", "MS", None, "mesa sabor")), ("62.01-5-00 x", _n("62.01-5-00 x.pdf", "62.01-5-00_x", "false", "6X", "62.01-5-00", "62.01-5-00 x")), ("00.00-0-00", _n("00.00-0-00.pdf", "00.00-0-00", "false", "0", None, "00.00-0-00")),
    ("Lojas {k} ME", _n("Lojas {k} ME.pdf", "Lojas_{k}_ME", "true", None, "{k}", "lojas {k} me")),
])
def name_forms(docs):
    t = F.col("text")
    first = F.when(~t.startswith("Lojas"), C.initials(t))
    return docs.select("doc_id", C.safe_file_name(t).alias("file"), C.storage_name(t).alias("stored"), C.is_legal_entity(t).alias("entity"), first.alias("initials"), C.activity_code(t).alias("activity"), C.lower_text(t).alias("lower"))


_k = _told("expense", "category", "number", "nature", "yes", "loose")


@cases([
    ("Material de consumo", _k("MATERIAL_CONSUMO", None, None, "Material de consumo", None, None)), ("Tecnologia Industrial Básica", _k("TIB", None, None, "Tecnologia Industrial Básica", None, None)), ("TIB", _k("TIB", None, None, "TIB", None, None)),
    ("Pessoa Jurídica", _k("SERVICO_APOIO_PJ", None, None, "Pessoa Jurídica", None, None)), ("terceiros contratados", _k("SERVICO_APOIO_PJ", None, None, "terceiros contratados", None, None)), ("Apoio técnico", _k("SERVICO_APOIO_PF", None, None, "Apoio técnico", None, None)),
    ("Serviços de terceiros", _k("DESPESA_OPERACIONAL", None, None, "SERVICO", None, None)), ("Pesquisa Básica", _k("DESPESA_OPERACIONAL", "PESQUISA_BASICA", "1", "Pesquisa Básica", None, None)), ("(PA)", _k("DESPESA_OPERACIONAL", "PESQUISA_APLICADA", "2", "(PA)", None, None)),
    ("DE - x", _k("DESPESA_OPERACIONAL", "DESENVOLVIMENTO_EXPERIMENTAL", "3", "DE - x", None, None)), ("nota de teste", _k("DESPESA_OPERACIONAL", None, None, "nota de teste", None, None)), ("Inovação tecnológica", _k("DESPESA_OPERACIONAL", "INOVACAO_TECNOLOGICA", None, "Inovação tecnológica", None, None)),
    ("Produto e processo", _k("DESPESA_OPERACIONAL", None, None, "PRODUTO", None, None)), ("Sim, claro", _k("DESPESA_OPERACIONAL", None, None, "Sim, claro", "true", None)), ("não", _k("DESPESA_OPERACIONAL", None, None, "não", "false", "false")), ("S", _k("DESPESA_OPERACIONAL", None, None, "S", "true", None)),
    (" ", _k(None, None, None, None, None, None)), (None, _k(None, None, None, None, None, None)), ("2", _k("DESPESA_OPERACIONAL", None, "2", "2", None, None)), ("YES", _k("DESPESA_OPERACIONAL", None, None, "YES", None, "true")),
])
def class_forms(docs):
    t = F.col("text")
    return docs.select("doc_id", C.expense_class(t).alias("expense"), C.research_category(t).alias("category"), C.research_class(t).alias("number"), C.nature(t).alias("nature"), C.yes_no(t).alias("yes"), C.loose_bool(t).alias("loose"))


@cases([
    ("(11) 3333-4444 / (11) 91234-5678", {"phones": "1133334444|FIXO|true;11912345678|CELULAR|false"}), ("/ 11912345678", {"phones": "11912345678|CELULAR|true"}), ("123 / 11 3333 4444", {"phones": "1133334444|FIXO|false"}),
    ("1133334444/11-3333-4444", {"phones": "1133334444|FIXO|true"}), (None, {"phones": ""}), (" ", {"phones": ""}), ("99", {"phones": ""}),
])
def phone_forms(docs):
    return docs.select("doc_id", _listed(C.phones(F.col("text")), "number", "kind", "is_primary").alias("phones"))


@cases([
    ('{"a": {k}}', {"found": '{"a":{k}}', "state": "plain"}), ('Here:\n```json\n{"a": {k}}\n```', {"found": '{"a":{k}}', "state": "fenced"}), ('so {"a": {k}} it is', {"found": '{"a":{k}}', "state": "outer"}),
    ('{"a": [1, {"b": {k}', {"found": '{"a":[1,{"b":{k}}]}', "state": "repaired"}), ('{"a": 1, "b": "cut of', {"found": '{"a":1}', "state": "repaired"}), ("nothing {k}", {"found": '{"error":"Invalid JSON response","raw":"nothing {k}"}', "state": "invalid"}),
    (None, {"found": '{"error":"Empty response","raw":""}', "state": "empty"}), ('{"a": 1, "b": [', {"found": '{"a":1,"b":[]}', "state": "repaired"}),
])
def json_replies(docs):
    return docs.select("doc_id", J.reply(F.col("text")).alias("r")).select("doc_id", F.col("r.json").alias("found"), "r.state")


@cases([
    ('{"form_data": {"senderName": "Ana {k}"}}', {"name": "Ana {k}", "updated": '{"form_data":{"senderName":"Ana {k}"},"status":"seen"}'}), ('{"sender_name": "Rui"}', {"name": "Rui", "updated": '{"sender_name":"Rui","status":"seen"}'}),
    ('{"status": "new"}', {"name": None, "updated": '{"status":"seen"}'}), ("broken", {"name": None, "updated": '{"status":"seen"}'}), (None, {"name": None, "updated": '{"status":"seen"}'}),
])
def json_updates(docs):
    t = F.col("text")
    return docs.select("doc_id", J.first_of(t, "$.form_data.sender_name", "$.form_data.senderName", "$.sender_name", "$.senderName").alias("name"), J.with_value(t, "status", F.lit("seen")).alias("updated"))


@cases([
    ("0 1", {"told": "base {k}", "known": "v2_late"}), ("0 3", {"told": "INITIAL CHUNK (first part) of 3: base {k}", "known": "v2_late"}), ("1 3", {"told": "MIDDLE CHUNK (part 2 of 3) of 3: base {k}", "known": "v2_late"}), ("2 3", {"told": "FINAL CHUNK (last part) of 3: base {k}", "known": "v2_late"}),
])
def chunk_instructions(docs):
    n = [F.split("text", " ")[i].cast("int") for i in (0, 1)]
    return docs.select("doc_id", J.chunk_instruction(F.concat(F.lit("base "), F.col("doc_id").cast("string")), *n).alias("told"), Q.known_profile(F.lit("v2_intermediate_2019_2022")).alias("known"))


@cases([
    ("short", {"source": "secondary", "text_": "longer {k}", "status": "FAILED", "number": "55", "batch": "INVALID_FORMPD"}), ("a much longer first text {k}", {"source": "primary", "text_": "a much longer first text {k}", "status": "NEEDS_AI", "number": "75", "batch": "COMPANY_NOT_FOUND"}),
    (None, {"source": "secondary", "text_": "longer {k}", "status": "FAILED", "number": "55", "batch": "INVALID_FORMPD"}),
])
def text_fallback(docs):
    found = docs.withColumn("u", X.usable_text(F.col("text"), F.concat(F.lit("longer "), F.col("doc_id").cast("string"))))
    valid = F.col("u.text_source") == "primary"
    return found.select("doc_id", F.col("u.text_source").alias("source"), F.col("u.text").alias("text_"), Q.extraction_status(valid, F.lit(True)).alias("status"), Q.confidence_number(F.when(valid, "MEDIUM").otherwise("LOW")).alias("number"), Q.batch_status(valid, F.lit(None)).alias("batch"))
