"""Entities and their links: resolution by keys, merging of contacts, phones, partners and activities, versions, deletes.

Rows meet by equi joins of keys and partial aggregates; no entity's rows are gathered in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermill.sources.tables import saved

from . import merge as M
from .relational import contains_join, numbered


def first_match(df: DataFrame, others: DataFrame, keys: list[tuple[str, str]], id_: str, name: str) -> DataFrame:
    """Adds the smallest id of the other table's rows that are equal in the first pair of columns that finds any."""
    found = []
    for i, (mine, theirs) in enumerate(keys):
        ids = others.filter(F.col(theirs).isNotNull()).groupBy(F.col(theirs).alias(mine)).agg(F.min(id_).alias(f"_m{i}"))
        df = df.join(ids, mine, "left")
        found.append(f"_m{i}")
    return df.withColumn(name, F.coalesce(*found)).drop(*found)


def new_links(left: DataFrame, right: DataFrame, on: str, ids: list[str], existing: DataFrame, block: int = 4096, most: int = 4_000_000) -> DataFrame:
    """Pairs of ids whose key is equal, with ``ambiguous`` where a left row finds several, without pairs that exist.

    The right ids of a key lie in lists of about ``block`` ids, and so do a left id's existing ones, by the same hash: lists are compared and pairs come out last, unshuffled. Left rows and
    existing pairs meet by the left id alone, so that they stay where they are if both lie by it. The right lists are sent to all, up to ``most`` ids in all; with more, existing
    ones are shuffled as lists. Only left ids that have several keys may tell a pair twice."""
    mine, theirs = ids
    several = right.filter(F.col(on).isNotNull()).groupBy(on).agg(F.count("*").alias("_n"))
    longest, number = several.agg(F.coalesce(F.max("_n"), F.lit(1)), F.coalesce(F.sum("_n"), F.lit(0))).first()
    parts = F.lit(int(longest / block) + 1)
    at = F.pmod(F.xxhash64(F.col(theirs).cast("string")), parts).cast("int").alias("_at")
    lists = right.filter(F.col(on).isNotNull() & F.col(theirs).isNotNull()).groupBy(on, at).agg(F.collect_set(theirs).alias("_theirs")).join(several, on)
    rows = left.filter(F.col(on).isNotNull()).select(mine, on).distinct()
    keys = rows.groupBy(mine).agg((F.count("*") > 1).alias("_again"))
    known = existing.select(mine, theirs).groupBy(F.col(mine).alias("_id"), at.alias("_block")).agg(F.collect_set(theirs).alias("_known"))
    told = rows.join(keys, mine)
    rows = told.withColumn("_at", F.explode(F.sequence(F.lit(0), parts.cast("int") - 1)))
    # an equality of blocks would become a key, by which both sides had to be moved
    same = (F.col(mine) == F.col("_id")) & (F.col("_at") <= F.col("_block")) & (F.col("_at") >= F.col("_block"))
    found = rows.join(known, same, "left").join(F.broadcast(lists) if number <= most else lists, [on, "_at"])
    left_out = F.when(F.col("_known").isNull(), F.col("_theirs")).otherwise(F.array_except("_theirs", "_known"))
    pairs = found.select(mine, F.explode_outer(left_out).alias(theirs), (F.col("_n") > 1).alias("ambiguous"), "_again").filter(F.col(theirs).isNotNull())
    once = pairs.filter(~F.col("_again")).drop("_again")
    if told.filter("_again").isEmpty():
        return once
    return once.unionByName(pairs.filter("_again").drop("_again").distinct())


def upsert_contacts(contacts: DataFrame, changes: DataFrame) -> DataFrame:
    """Contacts (id, name, email) after changes (name, email): a change belongs to the contact of its email, else of its name, else is new with
    a null id; an email that isn't null replaces the old one. Of several changes of one contact the one with the greatest email counts."""
    known = first_match(changes, contacts.select(F.col("email").alias("_email"), F.col("name").alias("_name"), "id"), [("email", "_email"), ("name", "_name")], "id", "found")
    best = known.filter("found is not null").groupBy(F.col("found").alias("id")).agg(F.max_by("name", F.struct(F.col("email").isNotNull(), "email", "name")).alias("_n"), F.max("email").alias("_e"))
    old = contacts.join(best, "id", "left").select("id", F.coalesce("_n", "name").alias("name"), F.coalesce("_e", "email").alias("email"), F.when(F.col("_n").isNull(), "KEPT").otherwise("UPDATED").alias("action"))
    new = known.filter("found is null").select(F.lit(None).cast("long").alias("id"), "name", "email", F.lit("INSERTED").alias("action")).distinct()
    return old.unionByName(new)


def sync_phones(phones: DataFrame, changes: DataFrame, overwrite: bool = False) -> DataFrame:
    """Phones (owner, number, is_primary) after changes: a primary one is only promoted, unless changes overwrite."""
    both = phones.select("owner", "number", F.col("is_primary").alias("old")).join(changes.groupBy("owner", "number").agg(F.bool_or("is_primary").alias("new")), ["owner", "number"], "full")
    value = F.coalesce("new", "old") if overwrite else F.coalesce(F.col("old"), F.lit(False)) | F.coalesce(F.col("new"), F.lit(False))
    return both.select("owner", "number", value.alias("is_primary"))


def upsert_partners(partners: DataFrame, changes: DataFrame) -> DataFrame:
    """Partners (name, country, share) after changes, by name and country, where no country equals no country."""
    plain = lambda df: df.withColumn("_c", F.coalesce("country", F.lit("\0"))).drop("country")
    merged = M.upsert(plain(partners), plain(changes), ["name", "_c"])
    return merged.withColumn("country", F.nullif("_c", F.lit("\0"))).drop("_c")


def activity_links(companies: DataFrame, activities: str, code) -> DataFrame:
    """company, code and is_primary of the activities of each company (an array of texts), the first being the primary one; repeats and
    codes that ``code`` makes null are left out."""
    rows = companies.select("company", F.posexplode(activities).alias("pos", "raw")).withColumn("code", code(F.col("raw"))).filter("code is not null")
    return rows.groupBy("company", "code").agg(F.min("pos").alias("pos")).select("company", "code", (F.col("pos") == 0).alias("is_primary"))


def switch_version(prompts: DataFrame, new: DataFrame) -> DataFrame:
    """Prompts (task, version, content, is_active) after a new content of some tasks: theirs become inactive, the new ones active with the next version."""
    tops = prompts.groupBy("task").agg(F.max("version").alias("_top"))
    added = new.join(tops, "task", "left").select("task", (F.coalesce("_top", F.lit(0)) + 1).alias("version"), "content", F.lit(True).alias("is_active"))
    touched = new.select("task", F.lit(True).alias("_new")).distinct()
    kept = prompts.join(touched, "task", "left").select("task", "version", "content", (F.col("is_active") & F.col("_new").isNull()).alias("is_active"))
    return kept.unionByName(added)


def delete_action(*counts: Column) -> Column:
    """CANCELADO where anything is linked, else DELETE."""
    linked = sum((F.coalesce(c, F.lit(0)) for c in counts), F.lit(0)) > 0
    return F.when(linked, "CANCELADO").otherwise("DELETE")


def purge(df: DataFrame, id_: str, users: list[DataFrame]) -> DataFrame:
    """The rows whose id no other table names."""
    for other in users:
        df = df.join(other.select(id_).filter(F.col(id_).isNotNull()).distinct(), id_, "left_anti")
    return df


def register_files(files: DataFrame, found: DataFrame) -> DataFrame:
    """Files (hash, company_id, name, deleted_at) after found ones (hash, company_id, name): a known hash is taken again; it keeps its company, takes
    the new name and is no longer deleted. Adds the event: FILE_REUSED, FILE_REGISTERED, or null for the others."""
    new = found.groupBy("hash").agg(F.min("company_id").alias("_c"), F.max("name").alias("_n"), F.lit(True).alias("_new"))
    both = files.withColumn("_old", F.lit(True)).join(new, "hash", "full")
    event = F.when(F.col("_new").isNull(), None).when(F.col("_old").isNull(), "FILE_REGISTERED").otherwise("FILE_REUSED")
    deleted = F.when(F.col("_new").isNull(), F.col("deleted_at"))
    return both.select("hash", F.coalesce("company_id", "_c").alias("company_id"), F.coalesce("_n", "name").alias("name"), deleted.alias("deleted_at"), event.alias("event"))


def migrated(links: DataFrame, there: DataFrame, keys: list[str]) -> DataFrame:
    """The links of the other table (``there``) and those that it lacks, once each; ``action`` tells KEPT and MIGRATED ones apart. The old table can be emptied then, and unused entities purged."""
    missing = links.select(*keys).distinct().join(there.select(*keys), keys, "left_anti").withColumn("action", F.lit("MIGRATED"))
    return there.select(*keys).withColumn("action", F.lit("KEPT")).unionByName(missing)


#: Month names.
MONTHS = ["janeiro", "fevereiro", "março", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro", "novembro", "dezembro"]


def transformed(value: Column, kind: str) -> Column:
    """A value by the transform of its column."""
    if kind in ("DATE_MMYYYY", "DATE_YYYY_MM"):
        return F.try_to_date(F.concat(value, F.lit("01")), "MMyyyydd").cast("string") if kind == "DATE_MMYYYY" else F.try_to_date(F.concat(value, F.lit("-01")), "yyyy-MM-dd").cast("string")
    if kind == "MONTH_NAME_PT":
        return F.nullif(F.array_position(F.lit(MONTHS), F.lower(F.trim(value))), F.lit(0)).cast("string")
    return {"UPPER": F.upper(value), "TRIM": F.trim(value)}.get(kind, value)


def required_text(pattern: str | None, kind: str) -> str | None:
    """The longest text that whatever a LIKE or REGEX pattern fits must hold; None if there is none, or if none is easily told."""
    if not pattern:
        return None
    runs, i = [""], 0
    while i < len(pattern):
        c = pattern[i]
        if kind == "DESC_LIKE":
            if c == "\\" and i + 1 < len(pattern):
                i += 1
                runs[-1] += pattern[i]
            elif c in "%_":
                runs.append("")
            else:
                runs[-1] += c
        elif c in "|(\\":  # either side may fit, or what is in brackets be missing
            return None
        elif c == "[":
            end = pattern.find("]", i + 2)
            if end < 0 or "[" in pattern[i + 1 : end]:
                return None
            runs, i = [*runs, ""], end
        elif c in "*?{":  # the character before may be missing
            runs = [*runs[:-1], runs[-1][:-1], ""]
            i = pattern.find("}", i) if c == "{" and "}" in pattern[i:] else i
        elif c in "+.^$":
            runs.append("")
        else:
            runs[-1] += c
        i += 1
    return max(runs, key=len) or None


def checked_rules(rules: DataFrame) -> DataFrame:
    """``rules`` with ``error``: REGEX_INVALID or LIKE_INVALID where a loose rule's pattern is none, else null."""
    regex = F.when(F.col("kind") == "DESC_REGEX", F.col("pattern"))
    like = F.when(F.col("kind") == "DESC_LIKE", F.col("pattern"))
    broken = F.expr("try_reflect('java.util.regex.Pattern', 'compile', _regex)").isNull()
    told = F.when(F.col("_regex").isNotNull() & broken, "REGEX_INVALID").when(~like.rlike(r"^(?s:[^\\]|\\[\\%_])*$"), "LIKE_INVALID")
    return rules.withColumn("_regex", regex).withColumn("error", told).drop("_regex")


def rubric_match(rows: DataFrame, rules: DataFrame, name: str = "rubric", block: int = 1000) -> DataFrame:
    """rows (id, code, description) with the rubric of the first kind of rule (rule, kind, pattern, rubric) that fits: CODE_EXACT, DESC_EXACT, DESC_LIKE,
    DESC_REGEX; of several the smallest rule. A pattern that is none fits nothing (see ``checked_rules``). The exact kinds are equi joins. Of the others a rule is tried on the texts that
    hold the text which its pattern requires; rules without one are tried on every text, in blocks of so many."""
    exact = lambda kind, column: rules.filter(F.col("kind") == kind).groupBy(F.col("pattern").alias(column)).agg(F.min_by("rubric", "rule").alias(f"_{kind}"))
    out = rows.join(exact("CODE_EXACT", "code"), "code", "left").join(exact("DESC_EXACT", "description"), "description", "left")
    loose = checked_rules(rules.filter(F.col("kind").isin("DESC_LIKE", "DESC_REGEX") & F.col("pattern").isNotNull())).filter("error is null").drop("error")
    required = F.udf(required_text, "string", useArrow=True)
    loose = saved(loose.withColumn("_needs", required("pattern", "kind")), "rules")
    texts = saved(rows.select("description").filter("description is not null").distinct(), "texts")
    indexed = contains_join(texts, "description", loose.filter("_needs is not null"), "_needs", [])
    rest = numbered(loose.filter("_needs is null"), ["kind", "rule"], "_n").withColumn("_block", F.floor((F.col("_n") - 1) / block))
    blocks = rest.agg(F.coalesce(F.max("_block"), F.lit(-1))).first()[0]
    tried = texts.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks)))).join(rest.drop("_n"), "_block").drop("_block") if blocks >= 0 else indexed.limit(0)
    # the kind is checked first, as a pattern of one kind needn't be one of the other
    like, regex = F.when(F.col("kind") == "DESC_LIKE", F.col("pattern")), F.when(F.col("kind") == "DESC_REGEX", F.col("pattern"))
    fits = F.coalesce(F.like("description", like), F.rlike("description", regex), F.lit(False))
    found = indexed.unionByName(tried).filter(fits).groupBy("description").agg(F.min_by("rubric", F.struct("kind", "rule")).alias("_LOOSE"))
    return out.join(found, "description", "left").withColumn(name, F.coalesce("_CODE_EXACT", "_DESC_EXACT", "_LOOSE")).drop("_CODE_EXACT", "_DESC_EXACT", "_LOOSE")
