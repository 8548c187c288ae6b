"""Completeness, cross-checks and the score of a record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermill.functions import columns as C


def present(c: Column, kind: str) -> Column:
    """Null, blank text and empty arrays are absent; 0 and false are present."""
    if kind == "string":
        return c.isNotNull() & (F.trim(c) != "")
    return c.isNotNull() & (F.size(c) > 0) if kind.startswith(("array", "map")) else c.isNotNull()


def completeness(fields: dict[str, Column]) -> Column:
    return sum((v.cast("int") for v in fields.values()), F.lit(0)) / F.lit(max(len(fields), 1))


def missing(fields: dict[str, Column]) -> Column:
    return F.filter(F.array(*[F.when(~v, F.lit(k)) for k, v in fields.items()]), lambda x: x.isNotNull())


def weighted(terms: list[tuple[Column, float]]) -> Column:
    return sum((F.when(c, w).otherwise(0.0) for c, w in terms), F.lit(0.0)) / F.lit(len(terms))


def applicable_ratio(rules: list[Column]) -> Column:
    """Share of true among rules that aren't null; 0.5 if none applies."""
    there = sum((c.isNotNull().cast("int") for c in rules), F.lit(0))
    true = sum((F.coalesce(c, F.lit(False)).cast("int") for c in rules), F.lit(0))
    return F.when(there == 0, 0.5).otherwise(true / there)


def score(complete: Column, confidence: Column, ratio: Column) -> Column:
    return 0.40 * complete + 0.30 * confidence + 0.30 * ratio


def band(overall: Column) -> Column:
    return F.when(overall >= 0.85, "HIGH").when(overall >= 0.60, "MEDIUM").otherwise("LOW")


def needs_review(overall: Column, n_missing: Column) -> Column:
    return F.when(overall >= 0.85, False).when(overall >= 0.60, n_missing > 0).otherwise(True)


# forms: the columns of ``forms.extract`` ------------------------------------------------------------------------------------------------

#: Mandatory fields of each profile.
RECEIPT = ["submission_receipt.sender_name", "submission_receipt.sender_cpf", "submission_receipt.authenticity_code"]
MANDATORY = {
    "v1_2017": ["cnpj", "fiscal_year", "projects.title", "projects.category"],
    "v1_2018": ["cnpj", "fiscal_year", "projects.title", "projects.category", "projects.innovative_element"],
    "v2_early": ["cnpj", "fiscal_year", *RECEIPT, "projects.title", "projects.category", "projects.innovative_element", "projects.human_resources"],
    "v2_late": ["cnpj", "fiscal_year", *RECEIPT, "projects.title", "projects.category", "projects.human_resources", "projects.expenses", "projects.economic_result_obtained"],
    "v3_early": ["cnpj", "fiscal_year", *RECEIPT, "projects.title", "projects.category", "projects.methodology", "projects.trl_initial", "projects.human_resources"],
    "v3_late": ["cnpj", "fiscal_year", *RECEIPT, "projects.title", "projects.category", "projects.methodology", "projects.trl_initial", "projects.trl_justification", "projects.human_resources"],
}
#: The profile that stands for a family, and fields that come first.
OF_FAMILY = {"v1_legacy_2017_2018": "v1_2018", "v2_intermediate_2019_2022": "v2_late", "v3_modern_2023_plus": "v3_early"}
FIRST = ["cnpj", "fiscal_year", *RECEIPT]
CATEGORIES = ["PESQUISA_BASICA", "PESQUISA_APLICADA", "DESENVOLVIMENTO_EXPERIMENTAL", "INOVACAO_TECNOLOGICA"]


def known_profile(name: Column) -> Column:
    """A profile, or the one that stands for a family, or v2_late."""
    out = F.lit("v2_late")
    for family, profile in OF_FAMILY.items():
        out = F.when(name == family, profile).otherwise(out)
    return F.when(name.isin(list(MANDATORY)), name).otherwise(out)


def _blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c.cast("string")) == "")


def form_field(name: str) -> Column:
    """Whether a field is there; of a project's fields, in any project."""
    if name == "cnpj":
        return ~_blank(F.col("company.company_id"))
    if name == "company_name":
        return ~_blank(F.col("company.legal_name"))
    if name == "fiscal_year":
        return F.col("fiscal_year").isNotNull()
    group, key = name.split(".")
    if group == "submission_receipt":
        return ~_blank(F.col(f"receipt.{key}"))
    if key in ("human_resources", "expenses", "equipment"):
        return F.exists("projects", lambda p: F.size(p[key]) > 0)
    return F.exists("projects", lambda p: ~_blank(p["project"][key]))


def missing_mandatory(profile: Column) -> Column:
    """The profile's mandatory fields that aren't there, in order."""
    lists = F.create_map(*[F.lit(x) for k, v in MANDATORY.items() for x in (k, v)])
    there = F.array(*[F.when(form_field(f), F.lit(f)) for f in sorted({f for v in MANDATORY.values() for f in v})])
    return F.array_except(F.coalesce(F.try_element_at(lists, profile), F.lit(MANDATORY["v2_early"])), there)


def estimated_confidence() -> Column:
    """Mean of the weights of the fields that are there; the narrative ones only of the first project."""
    ones = ["cnpj", "fiscal_year", "submission_receipt.sender_cpf", "submission_receipt.authenticity_code", "submission_receipt.expedition_at"]
    others = ["submission_receipt.sender_name", "company_name", "projects.title", "projects.category", "projects.trl_initial", "projects.trl_final", "projects.human_resources", "projects.expenses"]
    first = F.get("projects", F.lit(0))["project"]
    parts = [(form_field(f), 1.0) for f in ones] + [(form_field(f), 0.75) for f in others]
    stories = [(~_blank(first[f]), 0.6) for f in ("methodology", "innovative_element", "description")]
    total = lambda terms: sum((F.when(c, w).otherwise(0.0) for c, w in terms), F.lit(0.0))
    n = len(parts)
    return F.when(F.size("projects") > 0, (total(parts) + total(stories)) / (n + len(stories))).otherwise(total(parts) / n)


def cross_checks(profile: Column) -> dict[str, Column]:
    """The nine rules: true, false, or null where they don't apply to the profile."""
    newer, newest = profile.isin("v2_early", "v2_late", "v3_early", "v3_late"), profile.isin("v3_early", "v3_late")
    code, count, total = F.col("receipt.authenticity_code"), F.col("summary.project_count"), F.col("summary.declared_total").cast("double")
    spent = F.aggregate("projects", F.lit(0).cast("decimal(38,2)"), lambda s, p: (s + F.aggregate(p["expenses"], F.lit(0).cast("decimal(38,2)"), lambda t, e: (t + F.coalesce(e["amount"], F.lit(0))).cast("decimal(38,2)"))).cast("decimal(38,2)")).cast("double")
    category = lambda p: p["project"]["category"]
    return {
        "CV-01": F.coalesce(C.check_digits_hold(F.col("company.company_id")), F.lit(False)),
        "CV-02": F.coalesce(F.col("fiscal_year").between(2005, 2030), F.lit(False)),
        "CV-03": F.when(newer, form_field(RECEIPT[0]) & form_field(RECEIPT[1]) & form_field(RECEIPT[2])),
        "CV-04": F.when(profile.isin("v2_late", "v3_early", "v3_late"), form_field("projects.expenses")),
        "CV-05": F.when(newest & F.col("summary.found"), (count > 0) & (count == F.size("projects"))),
        "CV-06": F.when(newest & (total > 0) & (spent > 0), F.abs(spent - total) / total < 0.10),
        "CV-07": F.when(~_blank(code), code.rlike(r"^[A-Za-z0-9]{8}-[A-Za-z0-9]{4}-") | code.rlike(r"^\d{20,30}$")).when(newer, False),
        "CV-08": F.when(newer, form_field("projects.human_resources")),
        "CV-09": F.when(F.size("projects") > 0, F.forall(F.filter("projects", lambda p: ~_blank(category(p))), lambda p: F.upper(category(p)).isin(CATEGORIES))).otherwise(False),
    }


def valid_form(family: Column) -> Column:
    """valid, confidence, missing and needs_ai by the core fields, and the receipt's of the newer families."""
    core = [("company_info.cnpj", form_field("cnpj")), ("fiscal_year", form_field("fiscal_year")), ("projects", F.size("projects") > 0)]
    newer = F.coalesce(family, F.lit("v2_intermediate_2019_2022")).isin("v2_intermediate_2019_2022", "v3_modern_2023_plus")
    receipt = [(f, form_field(f) | ~newer) for f in (*RECEIPT[:2], "submission_receipt.expedition_at", RECEIPT[2])]
    gone = missing(dict(core + receipt))
    known = core[0][1] & core[1][1]
    complete, in_receipt = F.size(gone) == 0, F.forall(gone, lambda f: f.startswith("submission_receipt."))
    return F.struct(
        (complete | (known & in_receipt)).alias("valid"),
        F.when(complete, "HIGH").when(known | (F.size(gone) <= 2), "MEDIUM").otherwise("LOW").alias("confidence"),
        gone.alias("missing"), (~complete).alias("needs_ai"),
    )


def scored(forms: DataFrame) -> DataFrame:
    """Adds validation, missing_mandatory, cv_results (a struct), overall (not rounded), score_pct, score_band, needs_ai, ai_priority_fields and
    ai_candidates to the columns of ``forms.extract``."""
    out = forms.withColumn("profile", known_profile(F.coalesce("version.profile", "version.family"))).withColumn("validation", valid_form(F.col("version.family")))
    out = out.withColumn("missing_mandatory", missing_mandatory(F.col("profile"))).withColumn("cv_results", F.struct(*[v.alias(k) for k, v in cross_checks(F.col("profile")).items()]))
    needed = F.size(F.try_element_at(F.create_map(*[F.lit(x) for k, v in MANDATORY.items() for x in (k, v)]), "profile"))
    ratio = applicable_ratio([F.col(f"cv_results.`CV-0{i}`") for i in range(1, 10)])
    out = out.withColumn("completeness", (needed - F.size("missing_mandatory")) / needed).withColumn("confidence", estimated_confidence()).withColumn("cross_validation", ratio)
    out = out.withColumn("overall", score(F.col("completeness"), F.col("confidence"), F.col("cross_validation")))
    out = out.withColumns({"score_pct": F.bround(100 * F.col("overall"), 2), "score_band": band(F.col("overall")), "needs_ai": needs_review(F.col("overall"), F.size("missing_mandatory")), "ai_priority_fields": by_priority(F.col("missing_mandatory"))})
    candidates = F.transform("ai_priority_fields", lambda f: F.struct(f.alias("field"), F.lit("deterministic_not_confident").alias("reason"), F.when(f.isin(FIRST), "high").otherwise("medium").alias("priority")))
    return out.withColumn("ai_candidates", candidates)


def by_priority(fields: Column) -> Column:
    """Fields that come first before the others, each by name."""
    key = lambda f: F.struct((~f.isin(FIRST)).alias("later"), f.alias("field"))
    return F.transform(F.array_sort(F.transform(fields, key)), lambda x: x["field"])


def ai_queue(scores: DataFrame) -> DataFrame:
    """doc_id and the fields to ask for, of the forms whose score is low."""
    return scores.filter("score_band = 'LOW'").select("doc_id", F.col("ai_priority_fields").alias("fields"), F.lit("AI_QUEUED").alias("status"))


def extraction_status(valid: Column, needs_ai: Column) -> Column:
    return F.when(~F.coalesce(valid, F.lit(False)), "FAILED").when(needs_ai, "NEEDS_AI").otherwise("COMPLETED")


def confidence_number(band_: Column) -> Column:
    return F.when(band_ == "HIGH", 95).when(band_ == "MEDIUM", 75).otherwise(55)


def batch_status(valid: Column, company: Column) -> Column:
    return F.when(~F.coalesce(valid, F.lit(False)), "INVALID_FORMPD").when(company.isNull(), "COMPANY_NOT_FOUND").otherwise("PENDING_REVIEW")


#: Moves of a batch by event; None is any status.
MOVES = {
    ("COMPANY_NOT_FOUND", "company_registered"): "PENDING_REVIEW", ("PENDING_REVIEW", "ai_requested"): "AI_QUEUED", (None, "approved"): "APPROVED",
    (None, "discarded"): "DISCARDED", (None, "paused"): "PAUSED", ("PAUSED", "resumed"): "PENDING", ("PENDING", "requeued"): "PROCESSING", ("ERROR", "retried"): "PENDING",
}


def moved(status: Column, event: Column) -> Column:
    """The status after the event; unchanged where no move fits."""
    out = status
    for (before, what), after in MOVES.items():
        out = F.when((event == what) & (F.lit(True) if before is None else status == before), after).otherwise(out)
    return out


#: Shown names of fields, categories and statuses.
LABELS = {
    "company_type": "Tipo de Empresa", "company_status": "Situação da Empresa", "benefits_law_11196_8248": "Benefícios Lei 11.196/8.248", "capital_origin": "Origem do Capital",
    "group_relationship": "Relação com Grupo", "gross_operational_revenue": "Receita Operacional Bruta", "net_revenue": "Receita Líquida",
    "employee_count_with_contract": "Funcionários com Vínculo", "closed_year_with_tax_loss": "Fechou Ano com Prejuízo", "irpj_csll_apportionment": "Apuração IRPJ/CSLL",
    "incentives_reason": "Motivo Incentivos", "rnd_organizational_structure": "Estrutura Organizacional P&D",
    "situacao_na_receita": "Situação na Receita", "logradouro": "Logradouro", "numero": "Número", "sigla": "Sigla", "razao_social": "Razão Social", "natureza_juridica": "Natureza Jurídica",
    "data_fundacao": "Data de Fundação", "complemento": "Complemento", "tipo_endereco": "Tipo de Endereço", "representante_legal": "Representante Legal", "bairro": "Bairro", "cnae": "CNAE",
    "municipio": "Município", "cod_postal": "Código Postal", "cnpj": "CNPJ", "porte_da_empresa": "Porte da Empresa",
    "PESQUISA_BASICA": "Pesquisa Básica", "PESQUISA_APLICADA": "Pesquisa Aplicada", "DESENVOLVIMENTO_EXPERIMENTAL": "Desenvolvimento Experimental", "INOVACAO_TECNOLOGICA": "Inovação Tecnológica",
    "NAO_PREENCHIDO": "Não preenchido", "EM_PREENCHIMENTO": "Em preenchimento", "FINALIZADO": "Finalizado", "SUBMETIDO": "Submetido",
}
