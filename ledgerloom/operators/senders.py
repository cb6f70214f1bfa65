"""Whether a message's sender is a bank: a registry of domains, lookalikes, approvals, failed authentication, relabelling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.messages import address, auth_failed, domain, nfkc
from ledgerloom.functions.similarity import damerau
from ledgerloom.functions.text import bound
from ledgerloom.session import shared_path

SIMILAR = 0.85
# Letters of other scripts and the Latin letters that they look like.
LOOKALIKES = ("аеорсухіјѕһԁԛԝαοιρυνкмтвн", "aeopcyxijshdqwaoipuvkmtbh")


def domain_suffixes(name: Column) -> Column:
    """The domain and the domains above it, longest first."""
    labels = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))


#: Letters of the pieces by which texts and names inside them meet.
PIECE = 3


def _pieces(text: Column, n: Column) -> Column:
    return F.when(n <= F.length(text), F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda a: F.substring(text, a, n))).otherwise(F.array().cast("array<string>"))


def containing(texts: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """(``column``, ``name`` and its other columns) for each text that has a name inside.

    A name is looked for where a text has the name's rarest piece of three letters; a shorter name is its own piece.
    """
    named = names.filter("name <> ''")
    pieces = named.select("name").distinct().select("name", F.explode(F.array_distinct(_pieces(F.col("name"), F.least(F.lit(PIECE), F.length("name"))))).alias("_piece"))
    often = pieces.groupBy("_piece").agg(F.count("*").alias("_often"))
    rarest = pieces.join(often, "_piece").groupBy("name").agg(F.min(F.struct("_often", "_piece"))["_piece"].alias("_piece"))
    spread = F.flatten(F.array(*(_pieces(F.col(column), F.lit(n)) for n in range(1, PIECE + 1))))
    met = texts.select(column).distinct().select(column, F.explode(F.array_distinct(spread)).alias("_piece")).join(rarest, "_piece")
    return met.filter(F.contains(column, "name")).drop("_piece").join(named, "name")


def unreachable_phrases(phrases: DataFrame, terms: DataFrame) -> DataFrame:
    """The distinct ``phrase`` that no ``term`` reaches: one does if all its words are somewhere in the phrase."""
    asked = terms.filter("term IS NOT NULL").select("term", F.array_distinct(F.filter(F.split("term", " "), lambda w: w != "")).alias("_ws")).distinct()
    words = asked.select("term", F.size("_ws").alias("_k"), F.explode("_ws").alias("name"))
    listed = phrases.filter("phrase IS NOT NULL").select("phrase").distinct()
    found = containing(listed, "phrase", words.select("name").distinct()).join(words, "name").groupBy("phrase", "term", "_k").agg(F.count("*").alias("_n"))
    return listed.join(found.filter("_n = _k").select("phrase"), "phrase", "left_anti")


def sender_verdicts(domains: DataFrame, registry: DataFrame) -> DataFrame:
    """domain, verdict, bank for distinct ``domain``; ``registry`` has domain, bank and classification.

    The first that holds: registered itself, or below the longest registered one (its classification decides); a
    registered domain inside it; letters that look like one; punycode; spelt nearly like one; else unknown.
    """
    known = registry.select("bank", "classification", F.col("domain").alias("name"))
    suffixes = domains.select("domain", F.posexplode(domain_suffixes(F.col("domain"))).alias("depth", "name"))
    verified = suffixes.join(known, "name").groupBy("domain").agg(F.min_by(F.struct("bank", "classification"), F.struct("depth", "bank")).alias("v"))
    rest = domains.join(verified.select("domain"), "domain", "left_anti")
    inside = containing(rest, "domain", known).groupBy("domain").agg(F.min("bank").alias("held"))
    alike = rest.filter(F.col("domain").rlike("[^\\x00-\\x7F]")).withColumn("name", F.translate("domain", *LOOKALIKES)).join(known, "name").groupBy("domain").agg(F.min("bank").alias("twin"))
    # One edit in seven letters at most, so lengths of close names are close.
    sized = rest.withColumn("_n", F.explode(F.sequence(F.ceil(F.length("domain") * SIMILAR).cast("int"), F.floor(F.length("domain") / SIMILAR).cast("int"))))
    close = sized.join(known.withColumn("_n", F.length("name")), "_n").filter(damerau("domain", "name") >= SIMILAR).groupBy("domain").agg(F.min("bank").alias("near"))
    joined = domains.join(verified, "domain", "left").join(inside, "domain", "left").join(alike, "domain", "left").join(close, "domain", "left")
    kind = F.col("v.classification")
    verdict = (
        F.when(kind == "transaction_candidate", "transaction").when(kind == "statement_candidate", "statement").when(kind.isNotNull(), "noise")
        .when(F.col("held").isNotNull(), "spoof_inside").when(F.col("twin").isNotNull(), "spoof_lookalike").when(F.col("domain").rlike(r"(?:^|\.)xn--"), "spoof_punycode")
        .when(F.col("near").isNotNull(), "spoof_spelling").otherwise("unknown"))
    return joined.select("domain", verdict.alias("verdict"), F.col("v.bank").alias("bank"))


def sender_gate(messages: DataFrame, registry: DataFrame, names: DataFrame, approved: DataFrame, overrides: DataFrame) -> DataFrame:
    """msg_id, verdict, bank.

    ``messages`` has msg_id, froms (the From headers) and auth (the authentication header); ``names`` the banks' display
    names (name, in lower case); ``approved`` domain, bank, classification; ``overrides`` domain, bank, set_at, of which the latest counts. A
    domain that the user approved is not looked up; failed authentication undoes a good verdict; an override renames the
    bank of one and grants nothing.
    """
    # Headers repeat: all that they tell is worked out once for each, and met with the messages in one join.
    read = messages.select("msg_id", "auth", F.size(F.coalesce("froms", F.array().cast("array<string>"))).alias("_n"), F.get("froms", F.lit(0)).alias("_head"))
    told = _written(_told(read.filter("_head IS NOT NULL").select("_head").distinct(), registry, names, approved, overrides), "senders")
    rows = read.join(told, "_head", "left")
    base = F.col("_base")
    good = base.isin("transaction", "statement")
    final = F.when(F.col("_n") > 1, "spoof_headers").when((F.col("_n") == 0) | base.isNull(), "invalid").when(good & F.coalesce(auth_failed(F.col("auth")), F.lit(False)), "spoof_auth").otherwise(base)
    return rows.select("msg_id", "_bank", bound(final, lambda v: F.struct(v.alias("verdict"), v.isin("transaction", "statement").alias("good"))).alias("_v")).select("msg_id", "_v.verdict", F.when(F.col("_v.good"), F.col("_bank")).alias("bank"))


def _written(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` as a table in the shared folder: read several times, made once, and of a size that the joins know."""
    path = shared_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def _told(heads: DataFrame, registry: DataFrame, names: DataFrame, approved: DataFrame, overrides: DataFrame) -> DataFrame:
    """_head, _base, _bank of distinct From headers: the verdict without authentication (null: no sender) and the bank's name."""
    head = F.col("_head")
    read = _written(heads, "headers").select("_head", F.lower(F.rtrim(domain(head), F.lit("."))).alias("_raw"), F.nullif(F.lower(F.trim(F.regexp_replace(head, r"<[^<>]*>", ""))), F.coalesce(address(head), F.lit(""))).alias("shown"), (F.trim(head) != "").alias("_filled"))
    # Only what is not ASCII has another form.
    plain, other = (read.filter(F.coalesce(F.col("_raw").rlike("[^\\x00-\\x7F]"), F.lit(False)) == odd) for odd in (False, True))
    read = _written(plain.withColumn("domain", F.col("_raw")).unionByName(other.withColumn("domain", nfkc("_raw"))).drop("_raw"), "heads")
    looked = sender_verdicts(read.filter("domain IS NOT NULL").select("domain").distinct(), registry)
    claims = containing(read.filter("shown IS NOT NULL"), "shown", names).select("shown").distinct().withColumn("_claims", F.lit(True))
    listed = approved.select(F.lower(F.trim("domain")).alias("domain"), F.col("bank").alias("_approved"), (F.col("classification") == "statement_candidate").alias("_statement")).dropDuplicates(["domain"])
    latest = overrides.filter((F.trim("domain") != "") & (F.trim("bank") != "")).groupBy(F.lower(F.trim("domain")).alias("domain")).agg(F.max_by(F.trim("bank"), "set_at").alias("_renamed"))
    rows = read.join(looked, "domain", "left").join(listed, "domain", "left").join(latest, "domain", "left").join(claims, "shown", "left")
    base = F.when(F.col("_approved").isNotNull(), F.when(F.col("_statement"), "statement").otherwise("transaction")).when(
        F.col("verdict").isNull() | ((F.col("verdict") == "unknown") & F.col("_claims").isNull()), "unknown").when(F.col("verdict") == "unknown", "spoof_name").otherwise(F.col("verdict"))
    return rows.select("_head", F.when(F.col("_filled") & F.col("domain").isNotNull(), base).alias("_base"), F.coalesce("_renamed", "_approved", "bank").alias("_bank"))


def latest_overrides(reports: DataFrame) -> DataFrame:
    """domain, bank, feedback_id: the last report for each domain; blank ones count for nothing."""
    clean = reports.select(F.lower(F.trim("domain")).alias("domain"), F.trim("bank").alias("bank"), "feedback_id", "reported_at").filter("domain <> '' AND bank <> ''")
    w = Window.partitionBy("domain").orderBy(F.desc("reported_at"), F.desc("feedback_id"))
    return clean.withColumn("_p", F.row_number().over(w)).filter("_p = 1").drop("_p", "reported_at")
