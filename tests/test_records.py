"""Columns, forms, templates and merging on small fixtures."""

import datetime
from decimal import Decimal

from pyspark.sql import functions as F

from ledgermill.functions import columns as C
from ledgermill.operators import forms
from ledgermill.operators import merge as M
from ledgermill.operators import quality as Q
from ledgermill.operators import relational as R
from ledgermill.sources import templates


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


def test_columns(spark):
    assert one(spark, None, C.only_digits) == ""
    assert one(spark, "12.345.678/0001-95", C.company_id) == "12345678000195"
    assert one(spark, "123456789012345", C.company_id) == "123456789012345"
    assert one(spark, "none", C.company_id) is None
    assert one(spark, "12345678000195", C.masked_id) == "12.345.678/0001-95"
    assert one(spark, "11222333000181", C.check_digits_hold) is True
    assert one(spark, "11222333000182", C.check_digits_hold) is False
    assert one(spark, "11111111111111", C.check_digits_hold) is False
    assert one(spark, " Ação  é\tã ", C.normal_text) == "ACAO E A"
    assert one(spark, " : ", C.clean_value) is None
    assert one(spark, "\t  x", C.indent) == 6
    assert one(spark, "a/b?.doc", C.safe_file_name) == "a_b_.doc.pdf"
    assert one(spark, "Foo Ltda.", C.is_legal_entity) is True
    assert one(spark, "Samuel Mendes", C.is_legal_entity) is False
    assert one(spark, "total R$ 1.234,56 x", C.money_in_text) == Decimal("1234.56")
    assert one(spark, "nothing", C.money_in_text) is None
    assert one(spark, "1234.5", C.loose_money) == Decimal("1234.50")
    assert one(spark, "-5", C.loose_int) == 5
    assert one(spark, "Não", C.loose_bool) is False
    assert one(spark, "maybe", C.loose_bool) is None
    assert one(spark, "03/04/2024", C.loose_date) == datetime.date(2024, 4, 3)
    assert one(spark, "in 2021", C.loose_date) == datetime.date(2021, 1, 1)
    assert one(spark, "2019 2031 2022", lambda c: C.greatest_year(c, 2005, 2025)) == 2022
    assert one(spark, "a; b,|c", C.keywords) == ["a", "b", "c"]
    assert one(spark, "trabalho de campo", C.research_class) is None
    assert [tuple(p) for p in one(spark, "123 / (11) 91234-5678 / 11912345678", C.phones)] == [("11912345678", "CELULAR", False)]
    assert one(spark, "ana maria silva", C.initials) == "AM"
    assert one(spark, "x.CSV", C.file_type) == "CSV"


def test_versions(spark):
    def profile(text):
        return one(spark, text, lambda c: forms.detect_version(c)["profile"])

    assert profile("Dados da Empresa ... receita operacional bruta") == "v3_late"
    assert profile("DADOS DA EMPRESA") == "v3_early"
    assert profile("Recibo de Entrega [ITEM 1]") == "v2_late"
    assert profile("recibo de entrega ano base 2020") == "v2_early"
    assert profile("Dados pessoa jurídica") == "v1_2018"
    assert profile("x ( O ) y") == "v1_2017"
    assert profile("ANO BASE 2.023") == "v3_early"
    assert profile(None) == "v2_early"


def test_forms(spark):
    text = "Recibo de entrega\nNome: Ana Lima\nCPF:\n\n123.456.789-00\nExpedido em: 01/02/2023\nRazão Social: Foo Ltda\nCNPJ 11.222.333/0001-81\n1 Projeto um R$ 1.000,00\nTotal R$ 1.500,50"
    docs = forms.with_lines(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string"))
    found = docs.select("doc_id", forms.receipt_of(F.col("lines")).alias("r"), forms.company_of(F.col("text"), F.col("lines")).alias("c"), forms.summary_table(F.col("filled")).alias("s"))
    x = {r.doc_id: r for r in found.collect()}
    assert tuple(x[1].r) == ("Ana Lima", "12345678900", None, None)  # the label is told by a colon or dash right after its word
    assert tuple(x[1].c) == ("11222333000181", "Foo Ltda") and tuple(x[2].c) == (None, None)
    assert not any(r.s.found for r in x.values())  # rows without a head are no table


def test_long_texts_and_many_blocks(spark):
    """Forms of thousands of lines, and many projects, stay one row each."""
    block = "Programa/Atividades de PD&I - {i}\nItem/Título do Projeto de PD&I\nProjeto {i} x\nItens de dispêndio\nPeças R$ {i},00\n"
    text = "Dados da Empresa\n" + "".join(block.format(i=i) for i in range(1, 40)) + "linha\n" * 3000
    out = forms.extract(spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string"), 2025).collect()
    assert len(out) == 2 and out[0] == out[1] and len(out[0].projects) == 39
    assert all([e.amount for e in p.expenses] == [Decimal(i)] for i, p in enumerate(out[0].projects, 1))


def test_streams_in_several_batches(spark, tmp_path):
    from ledgermill.streaming.states import folded_stream

    at = f"file://{tmp_path}/in"
    rows = [(i, datetime.datetime(2024, 1, 1, 0, i % 60), i % 7, ["click", "view"][i % 2]) for i in range(300)]
    table = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string")
    for part in range(5):
        table.filter(F.col("event_id") % 5 == part).coalesce(1).write.mode("append").parquet(at)
    found = {r.user_id: (r.state, r.last_event_id, r.n_events) for r in folded_stream(spark, at, files_per_trigger=2).collect()}
    want = {}
    for u in range(7):
        mine = [r for r in rows if r[2] == u]
        last = max(mine, key=lambda r: (r[1], r[0]))
        want[u] = (last[3], last[0], len(mine))
    assert found == want


def test_templates(spark, tmp_path):
    rows = spark.createDataFrame([("1", None, "b"), (None, "", None)], "id string, `E-mail` string, email string")
    found = templates.map_columns(rows, {"id": "id", "email": "mail", "E-mail": "mail", "gone": "x"}).collect()
    assert [(r.id, r.mail, r.status) for r in found] == [("1", "b", "SUCCESS"), (None, "", "ERROR")]
    assert templates.map_columns(rows, {"email": "mail", "E-mail": "mail"}, strict=True).first().mail is None
    (tmp_path / "a.csv").write_text('made by\nid,name\n1,"a, ""b"""\n')
    assert [tuple(r) for r in templates.read_csv(spark, str(tmp_path / "a.csv"), 1).collect()] == [("1", 'a, "b"')]
    (tmp_path / "b.csv").write_text("by another\nname,other\nx,y\n")  # each file has its own header
    both = templates.read_csv(spark, str(tmp_path / "*.csv"), 1).select("id", "name", "other").collect()
    assert sorted(map(tuple, both), key=str) == [("1", 'a, "b"', None), (None, "x", "y")]
    assert templates.first_sheet(templates.workbook([["a", None, "<b>"], [None], ["1"]])) == [["a", None, "<b>"], [None], ["1"]]
    assert templates.listing(spark, f"file://{tmp_path}/none").count() == 0


def test_merging(spark):
    base = spark.createDataFrame([(1, "a", None), (2, "b", "x")], "k int, v string, w string")
    new = spark.createDataFrame([(2, None, "y"), (3, "c", "z")], "k int, v string, w string")
    found = {r.k: (r.v, r.w, r.action) for r in M.upsert(base, new, ["k"], keep_old=("w",)).collect()}
    assert found == {1: ("a", None, "KEPT"), 2: ("b", "x", "UPDATED"), 3: ("c", "z", "INSERTED")}
    assert {(r.k, r.created) for r in M.get_or_create(base, new, ["k"]).collect()} == {(1, False), (2, False), (3, True)}
    chunks = R.chunked(spark.range(1203).toDF("i"), ["i"], 500).groupBy("chunk").count().collect()
    assert {r.chunk: r["count"] for r in chunks} == {0: 500, 1: 500, 2: 203}


def test_quality(spark):
    row = spark.range(1).select(Q.applicable_ratio([F.lit(True), F.lit(None).cast("boolean"), F.lit(False)]).alias("r"), Q.applicable_ratio([F.lit(None).cast("boolean")]).alias("n"), Q.band(F.lit(0.85)).alias("b"), Q.needs_review(F.lit(0.7), F.lit(0)).alias("x")).first()
    assert tuple(row) == (0.5, 0.5, "HIGH", False)


def test_sums_of_next_rows(spark):
    """Prefix sums and the search in them against the plain rule, on short lists and one of 20,000 rows."""
    import random
    import time

    rng = random.Random(2)
    lists = [[rng.choice([0, -1, 1, 2, 3, 5, 8, 10, 100]) for _ in range(n)] for n in (0, 1, 2, 5, 63, 64, 65, 130, 200)]
    rows = [(i, [(Decimal(x),) for x in xs]) for i, xs in enumerate(lists)]
    df = spark.createDataFrame(rows, "i int, r array<struct<amount:decimal(18,2)>>").withColumn("s", forms.running_sums(F.col("r")))
    found = df.select("i", "s", F.transform("r", lambda e, i: forms.adds_up(F.col("s"), e["amount"], i)).alias("adds")).collect()
    for i, sums, adds in found:
        want = [0]
        for x in lists[i]:
            want.append(want[-1] + max(x, 0))
        assert list(map(int, sums)) == want
        assert adds == [x > 0 and any(s > want[j + 1] and abs(s - want[j + 1] - x) * 100 < 3 * x for s in want[j + 2 :]) for j, x in enumerate(lists[i])]
    expense = ",".join(f"{k}:{v}" for k, v in forms.EXPENSE.items())
    big = spark.range(20_000).select(F.struct(*[{"project_index": (F.col("id") % 3).cast("int"), "category": F.concat(F.lit("c"), F.col("id").cast("string")), "amount": (F.col("id") % 97 + 1).cast("decimal(18,2)")}.get(k, F.lit(None)).cast(v).alias(k) for k, v in forms.EXPENSE.items()]).alias("e"))
    one = big.groupBy().agg(F.collect_list("e").cast(f"array<struct<{expense}>>").alias("r"))
    began = time.time()
    assert one.select(F.size(forms.leaf_expenses(F.col("r")))).first()[0] > 0
    assert time.time() - began < 30


def test_numbering_and_as_of(spark):
    import random

    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, i int").repartition(7)
    want = {}
    for g, i in sorted(rows, key=lambda r: r[1]):
        want[i] = 1 + sum(1 for h, j in rows if h == g and j < i)
    assert {r.i: r.n for r in R.numbered(df, ["i"], "n", within=["g"]).collect()} == want
    assert {r.i: r.n for r in R.numbered(df, ["i"], "n").collect()} == {i: i + 1 for i in range(500)}
    values = [(rng.randrange(300), k, k if k % 3 else None) for k in range(40)]
    v = spark.createDataFrame(values, "t int, k int, v int")
    uses = spark.createDataFrame([(rng.randrange(300), k) for k in range(1000, 1300)], "t int, k int")
    for stretch in (3, 100_000):
        got = {r.k: r.v for r in R.last_before(uses, v, "t", "v", "k", stretch).collect()}
        plain = {}
        for t, k in uses.collect():
            if mine := [x for x in values if x[0] <= t]:
                plain[k] = max(mine, key=lambda x: (x[0], x[1]))[2]
        assert got == plain
    assert R.last_before(uses, v.limit(0), "t", "v", "k").count() == 0


def test_contains_join(spark):
    import random

    rng = random.Random(8)
    words = ["the", "of", "rare", "bolt", "screw", "a", "nut and", "washer"]
    texts = [(i, i % 2, " ".join(rng.choice(words) for _ in range(12))) for i in range(300)] + [(900, 0, None), (901, 1, "")]
    asked = [(j, j % 2, w) for j, w in enumerate(["the of", "rare bolt", "nut and washer", "a", "x", "", None, "screw the a", "the of"])]
    hay, needles = spark.createDataFrame(texts, "i int, g int, text string"), spark.createDataFrame(asked, "j int, g int, w string")
    plain = lambda same: sorted((i, j) for i, g, t in texts for j, h, w in asked if t and w and w in t and (g == h or not same))
    for more in ({}, {"most": 1}, {"hot": 3}, {"most": 1, "hot": 2, "size": 2}):
        assert sorted((r.i, r.j) for r in R.contains_join(hay, "text", needles, "w", ["g"], **more).select("i", "j").collect()) == plain(True)
        assert sorted((r.i, r.j) for r in R.contains_join(hay, "text", needles.drop("g"), "w", [], **more).select("i", "j").collect()) == plain(False)
    assert R.contains_join(hay, "text", needles.limit(0), "w", ["g"]).count() == 0


def test_loose_rules(spark):
    from ledgermill.operators import links as K

    needs = [("DESC_LIKE", "%ab_cde%", "cde"), ("DESC_LIKE", r"\%x%", "%x"), ("DESC_LIKE", "%_%", None), ("DESC_REGEX", "abc?de+f", "f"), ("DESC_REGEX", "a|b", None), ("DESC_REGEX", "bolt[0-9]{2,3}xy", "bolt"), ("DESC_REGEX", r"\d+", None), ("DESC_REGEX", None, None)]
    assert [K.required_text(p, kind) for kind, p, _ in needs] == ["cde", "%x", None, "ab", None, "bolt", None, None]
    rules = [(1, "DESC_REGEX", "(", "broken"), (2, "DESC_LIKE", "%bolt_", "like"), (3, "DESC_REGEX", "^s.rew[0-9]?$", "regex"), (4, "DESC_REGEX", "nut|washer", "either"), (5, "DESC_LIKE", r"x\y", "bad"), (6, "CODE_EXACT", "7", "code"), (7, "DESC_REGEX", "zzz|screw", "late")]
    texts = ["bolts", "a bolt", "screw", "screw1", "washers", None, "", "(", "x"]
    rows = spark.createDataFrame([(i, "7" if i == 4 else "1", t) for i, t in enumerate(texts)], "i int, code string, description string")
    table = spark.createDataFrame(rules, "rule int, kind string, pattern string, rubric string")
    for block in (1, 1000):
        got = {r.i: r.rubric for r in K.rubric_match(rows, table, block=block).collect()}
        assert got == {0: "like", 1: None, 2: "regex", 3: "regex", 4: "code", 5: None, 6: None, 7: None, 8: None}
    assert {r.rule: r.error for r in K.checked_rules(table).collect()} == {1: "REGEX_INVALID", 2: None, 3: None, 4: None, 5: "LIKE_INVALID", 6: None, 7: None}
    assert K.rubric_match(rows, table.limit(0)).filter("rubric is not null").count() == 0


def test_headers_and_first_sheets(spark, tmp_path):
    import io
    import zipfile

    (tmp_path / "a.csv").write_text("t\nid,a`b,id,\n1,2,3,4\n")
    (tmp_path / "b.csv").write_text('t\n"a`b",x\n"5, 6",7\n')
    got = templates.read_csv(spark, str(tmp_path / "*.csv"), 1)
    assert sorted(got.columns) == sorted(["id0", "a`b", "id2", "_c3", "x"])
    at = {n: i for i, n in enumerate(got.columns)}
    rows = sorted(([r[at[n]] for n in ("id0", "a`b", "id2", "_c3", "x")] for r in got.collect()), key=str)
    assert rows == [["1", "2", "3", "4", None], [None, "5, 6", None, None, "7"]]
    out = io.BytesIO(templates.workbook([["SECOND"]]))
    with zipfile.ZipFile(out, "a") as z:
        z.writestr("xl/worksheets/sheet12.xml", zipfile.ZipFile(io.BytesIO(templates.workbook([["FIRST"]]))).read("xl/worksheets/sheet1.xml"))
        z.writestr("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="b" sheetId="2" r:id="r9"/><sheet name="a" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r9" Target="worksheets/sheet12.xml"/></Relationships>')
    assert templates.first_sheet(out.getvalue()) == [["FIRST"]]
