"""Scalar functions of business records as plain column expressions: ids, texts, money, dates, classes. Null stays null unless stated."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
#: Latin letters whose canonical decomposition starts with a plain letter.
_ACCENTED = [chr(i) for i in range(0xC0, 0x180) if len(unicodedata.normalize("NFD", chr(i))) > 1]
_PLAIN = "".join(unicodedata.normalize("NFD", x)[0] for x in _ACCENTED)


def only_digits(c: Column) -> Column:
    """Null becomes empty."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9]+", "")


def company_id(c: Column) -> Column:
    """Digits padded to 14, never cut; null without digits."""
    d = only_digits(c)
    return F.when(d == "", None).when(F.length(d) < 14, F.lpad(d, 14, "0")).otherwise(d)


def masked_id(c: Column) -> Column:
    return F.regexp_replace(c, r"^(\d{2})(\d{3})(\d{3})(\d{4})(\d{2})$", r"$1.$2.$3/$4-$5")


def check_digits_hold(c: Column) -> Column:
    """14 digits, not all alike, with two weighted check digits modulo 11."""
    digits = F.transform(F.split(F.substring(c, 1, 14), ""), lambda x: x.try_cast("int"))

    def digit(weights: list[int]) -> Column:
        rest = F.aggregate(F.zip_with(F.slice(digits, 1, len(weights)), F.lit(weights), lambda a, b: a * b), F.lit(0), lambda a, x: a + x) % 11
        return F.when(rest < 2, 0).otherwise(11 - rest)

    first = [5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2]
    return F.when(~c.rlike(r"^\d{14}$") | c.rlike(r"^(\d)\1{13}$"), False).otherwise((F.get(digits, F.lit(12)) == digit(first)) & (F.get(digits, F.lit(13)) == digit([6, *first])))


def strip_accents(c: Column) -> Column:
    return F.translate(c, "".join(_ACCENTED), _PLAIN)


def upper_text(c: Column) -> Column:
    """Upper case, no accents, single spaces, also at the ends; null becomes empty."""
    return F.regexp_replace(strip_accents(F.upper(F.coalesce(c, F.lit("")))), r"\s+", " ")


def lower_text(c: Column) -> Column:
    """Lower case, no accents, single spaces; null becomes empty."""
    return clean(strip_accents(F.lower(F.coalesce(c, F.lit("")))))


def let(value: Column, result: Callable[[Column], Column]) -> Column:
    """The result for a value that is computed once, however often the result names it."""
    return F.get(F.transform(F.array(value), result), F.lit(0))


def clean(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normal_text(c: Column) -> Column:
    """Upper case, no accents, single spaces."""
    return clean(strip_accents(F.upper(c)))


def clean_value(c: Column) -> Column:
    """Single spaces, no marks around; null if nothing is left."""
    return F.nullif(F.btrim(F.regexp_replace(c, r"\s+", " "), F.lit(" .;:-")), F.lit(""))


def indent(c: Column) -> Column:
    x = F.replace(c, F.lit("\t"), F.lit("    "))
    return F.length(x) - F.length(F.ltrim(x))


def has(c: Column, pattern: str) -> Column:
    return c.rlike("(?iu)" + pattern)


def safe_file_name(c: Column, default: str = "arquivo.pdf") -> Column:
    """Forbidden marks become underscores, white space single blanks; the name ends in .pdf; without a name the default one."""
    name = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r'[\\/:*?"<>|]', "_"), r"\s+", " "))
    return F.when(name == "", default).when(F.lower(name).endswith(".pdf"), name).otherwise(F.concat(name, F.lit(".pdf")))


def storage_name(c: Column, at: Column | None = None) -> Column:
    """Marks beyond letters, digits, dot, underscore and dash become underscores; with ``at``, after its milliseconds since 1970."""
    name = F.regexp_replace(c, "[^a-zA-Z0-9._-]", "_")
    return name if at is None else F.concat_ws("_", F.unix_millis(at.cast("timestamp")).cast("string"), name)


def activity_code(c: Column) -> Column:
    """Digits, dots and dashes of an activity's code; the placeholder of noughts and a code without digits give null."""
    code = F.regexp_replace(c, "[^0-9.-]", "")
    return F.when(F.regexp_replace(code, "[.0-]", "") != "", code)


def target_path(company: Column, year: Column, name: Column) -> Column:
    return F.concat_ws("/", company, year.cast("string"), F.lit("FORM"), safe_file_name(name))


def extension(c: Column) -> Column:
    return F.lower(F.element_at(F.split(c, r"\."), -1))


def file_type(c: Column) -> Column:
    return F.when(extension(c) == "csv", "CSV").when(extension(c) == "xls", "XLS").otherwise("XLSX")


def initials(c: Column) -> Column:
    return F.array_join(F.transform(F.slice(F.split(clean(c), " "), 1, 2), lambda x: F.upper(F.substring(x, 1, 1))), "")


#: Words in the names of legal entities, upper case.
LEGAL_WORDS = [
    "LTDA", "S/A", "S.A.", "SA", "ME", "EPP", "EIRELI", "PME", "MICROEMPRESA", "SOCIEDADE", "ASSOCIACAO", "ASSOCIAÇÃO", "FUNDACAO", "FUNDAÇÃO",
    "SERVICOS", "SERVIÇOS", "INDUSTRIA", "CONSTRUTORA", "HOLDING", "PARTICIPACOES", "PARTICIPAÇÕES",
]


def is_legal_entity(name: Column) -> Column:
    """One of the words as a word of its own, with or without accents; false for null."""
    words = "|".join(w.replace(".", r"\.") for w in LEGAL_WORDS if w.isascii())
    return F.coalesce(normal_text(name).rlike(rf"(^|[^A-Z])({words})($|[^A-Z])"), F.lit(False))


def phones(c: Column) -> Column:
    """Numbers of a text split at slashes: digits (30 at most), kind, primary (the first part that isn't blank, if it is a number), without
    repeats; an empty array for null."""
    there = F.filter(F.split(F.coalesce(c, F.lit("")), "/"), lambda x: F.trim(x) != "")
    parts = F.transform(there, lambda x, i: F.struct(F.substring(only_digits(x), 1, 30).alias("number"), (i == 0).alias("is_primary")))
    valid = F.filter(parts, lambda p: F.length(p["number"]) >= 8)
    numbers = F.transform(valid, lambda p: p["number"])
    kept = F.filter(valid, lambda p, i: F.array_position(numbers, p["number"]) == i + 1)
    mobile = lambda n: (F.length(n) == 11) & (F.substring(n, 3, 1) == "9")
    return F.transform(kept, lambda p: F.struct(p["number"].alias("number"), F.when(mobile(p["number"]), "CELULAR").otherwise("FIXO").alias("kind"), p["is_primary"].alias("is_primary")))


def money_shown(c: Column) -> Column:
    """R$ 1.234,56"""
    return F.concat(F.lit("R$ "), F.translate(F.format_number(c, 2), ",.", ".,"))


def date_shown(c: Column) -> Column:
    return F.date_format(c, "dd/MM/yyyy")


def _br_number(c: Column) -> Column:
    return F.translate(c, ",.", ".").try_cast(MONEY)


def money_in_text(c: Column) -> Column:
    """The first amount after R$, points marking thousands; null if there is none or it isn't a number."""
    return _br_number(F.regexp_extract(c, r"(?i)R\$\s*([0-9.,]+)", 1))


def money_or_last_number(c: Column) -> Column:
    """The first amount after R$, else the number at the end."""
    marked = F.nullif(F.regexp_extract(c, r"(?i)R\$\s*([0-9.,]+)", 1), F.lit(""))
    return _br_number(F.coalesce(marked, F.regexp_extract(c, "([0-9.,]+)$", 1)))


def loose_money(c: Column) -> Column:
    """With a comma, points mark thousands; else a point marks decimals."""
    plain = lambda x: F.when(x.contains(","), F.translate(x, ",.", ".")).otherwise(x).try_cast(MONEY)
    # what is cut at the ends goes anyway; most texts then need no pattern, which costs the most here
    bare = lambda x: F.when(F.ltrim(x, F.lit("0123456789.,-")) == "", x).otherwise(F.regexp_replace(x, r"[^0-9,.\-]+", ""))
    return let(let(F.btrim(c, F.lit("R$ ")), bare), plain)


def loose_int(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]+", "").try_cast("bigint")


def first_int(c: Column) -> Column:
    return F.regexp_extract(c, "([0-9]{1,6})", 1).try_cast("int")


def amount_key(c: Column) -> Column:
    return F.coalesce(c.try_cast(MONEY), F.lit(0).cast(MONEY)).cast("string")


def within(a: Column, b: Column, tolerance: float) -> Column:
    """Null where either is null or nought."""
    return F.when((a == 0) | (b == 0), None).otherwise(F.abs(a - b) / F.abs(b) < tolerance)


def loose_bool(c: Column) -> Column:
    x = F.lower(F.trim(strip_accents(c)))
    return F.when(x.isin("sim", "yes", "true", "1"), True).when(x.isin("nao", "no", "false", "0"), False)


def br_date(c: Column) -> Column:
    return F.try_to_date(F.trim(c), "d/M/yyyy")


def yes_no(c: Column) -> Column:
    """By the beginning: true for SIM or a lone S, false for NAO or a lone N, else null."""
    x = normal_text(c)
    return F.when(x.startswith("SIM") | (x == "S"), True).when(x.startswith("NAO") | (x == "N"), False)


def loose_date(c: Column) -> Column:
    """Day, month and year at the beginning (slashes or dashes, whatever follows), else an ISO date, else 1 January of a year 20yy in the text."""
    x = F.trim(c)
    # casts read such dates faster than formats do, which raise errors within
    dmy = F.translate(F.regexp_extract(x, r"^\d{1,2}[/-]\d{1,2}[/-]\d{4}", 0), "/", "-")
    month = F.substring_index(F.substring_index(dmy, "-", 2), "-", -1)
    parts = F.concat_ws("-", F.substring_index(dmy, "-", -1), month, F.substring_index(dmy, "-", 1))
    iso = F.regexp_extract(x, r"^\d{4}-\d{2}-\d{2}", 0)
    year = F.regexp_extract(c, r"\b(20\d{2})\b", 1).try_cast("int")
    return F.coalesce(F.when(dmy != "", parts).try_cast("date"), iso.try_cast("date"), F.when(year.isNotNull(), F.make_date(year, F.lit(1), F.lit(1))))


def fiscal_year(text: Column, as_of_year: int, name: Column | None = None) -> Column:
    """The labelled year, else the greatest year from 2005 to the one after ``as_of_year`` in the text; a year in the company's ``name`` is none."""
    said = F.regexp_extract(text, r"(?i)(?:ANO\s*BASE|ANO-?CALENDARIO)\s*[:\-]?\s*(20\d{2})", 1).try_cast("int")
    rest = text if name is None else F.replace(text, F.coalesce(name, F.lit("")), F.lit(" "))
    return F.coalesce(said, greatest_year(rest, 2005, as_of_year + 1))


def year_or_last(year: Column, as_of: Column) -> Column:
    """The year, or the one before ``as_of``."""
    return F.coalesce(year, F.year(as_of) - 1)


def date_folder(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd")


def greatest_year(c: Column, low: int, high: int) -> Column:
    years = F.transform(F.regexp_extract_all(c, F.lit(r"\b(20\d{2})\b"), 1), lambda y: y.try_cast("int"))
    return F.array_max(F.filter(years, lambda y: y.between(low, high)))


def keywords(c: Column, most: int = 5) -> Column:
    return F.slice(F.filter(F.transform(F.split(c, "[;,|]"), lambda x: F.trim(x)), lambda x: x != ""), 1, most)


def expense_class(c: Column) -> Column:
    """Ordered keywords, without accents; another text is an operational expense, a blank one null."""
    found = lambda x: (
        F.when(x == "", None)
        .when(x.contains("material"), "MATERIAL_CONSUMO")
        .when(x.contains("tecnologia industrial") | x.contains("tib"), "TIB")
        .when(x.contains("pessoa jur") | x.contains("terceiros contratad"), "SERVICO_APOIO_PJ")
        .when(x.contains("apoio tecnico") | x.contains("servico de apoio"), "SERVICO_APOIO_PF")
        .otherwise("DESPESA_OPERACIONAL")
    )
    # as ``lower_text``, without its patterns where there is nothing for them
    lower = lambda x: F.when(F.octet_length(x) == F.length(x), x).otherwise(strip_accents(x))
    odd = lambda x: functools.reduce(Column.__or__, [x.contains(s) for s in ("  ", "\t", "\n", "\x0b", "\f", "\r")])
    single = lambda x: F.when(odd(x), clean(x)).otherwise(F.trim(x))
    return let(let(let(F.lower(F.coalesce(c, F.lit(""))), lower), single), found)


#: Research categories, their codes and their numbers.
RESEARCH = [("PESQUISA_BASICA", "PB", 1), ("PESQUISA_APLICADA", "PA", 2), ("DESENVOLVIMENTO_EXPERIMENTAL", "DE", 3), ("INOVACAO_TECNOLOGICA", None, None)]


def research_category(c: Column) -> Column:
    """By name (spaces or underscores), or by a code that stands alone or in brackets; null for another text."""
    x, out = F.translate(normal_text(c), "_", " "), F.lit(None).cast("string")
    for name, code, _ in reversed(RESEARCH):
        found = x.contains(name.replace("_", " "))
        out = F.when(found if code is None else found | x.rlike(rf"^{code}$|\({code}\)|^{code}\s*-"), name).otherwise(out)
    return out


def research_class(c: Column) -> Column:
    """The number of the category; a number from 1 to 3 is taken as it is."""
    name, out = research_category(c), F.trim(c).try_cast("int")
    out = F.when(out.between(1, 3), out)
    for category, _, number in RESEARCH[:3]:
        out = F.when(name == category, number).otherwise(out)
    return out


def nature(c: Column) -> Column:
    """PRODUTO, PROCESSO or SERVICO, else the text's first 50 characters; null for a blank text."""
    x = normal_text(c)
    return F.when(x == "", None).when(x.contains("PRODUTO"), "PRODUTO").when(x.contains("PROCESSO"), "PROCESSO").when(x.contains("SERVI"), "SERVICO").otherwise(F.substring(F.trim(c), 1, 50))


def equipment_origin(c: Column) -> Column:
    x = normal_text(c)
    return F.when(x.contains("EQUIPAMENTOS NACIONAIS"), "NACIONAL").when(x.contains("EQUIPAMENTOS IMPORTADOS"), "IMPORTADO")


def mapped(c: Column, labels: dict[str, str]) -> Column:
    """The label of a code, or the code."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]), c), c)


def record_label(*names: Column, payload: Column) -> Column:
    """The first name there is, else the payload."""
    return F.coalesce(*names, payload)
