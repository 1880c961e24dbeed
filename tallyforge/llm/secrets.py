"""Secret scans with multipart credential linking.

Base kinds are found by pattern, leftmost and without overlap a kind; positions are code points, running sums
over the matches and the gaps between them. Weak candidates (identifiers, keys and endpoints that say little alone)
are reported only when complementary parts start within one scope of them: an interval join on scope
buckets. Built-in functions only.

Null texts are empty. Rows are told apart by id and text, so ids may repeat or be null; repeated rows give
repeated results. Texts are scanned whole. Documents without secrets give empty span lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.llm.text import let
from tallyforge.runtime import table

#: Two parts belong together if they start at most this many code points apart.
SCOPE = 200

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"

IDENT = r"""(?:ASIA|AIDA|AROA|AGPA)[A-Z0-9]{12,}|(?i:client_?id|access_?id|user_?name|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{4,}"""
KEY = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_=-]*[0-9])(?=[A-Za-z0-9+/_=-]*[A-Z])(?=[A-Za-z0-9+/_=-]*[a-z])[A-Za-z0-9+/_=-]{24,}"
ENDPOINT = r"""(?:https?|s3|postgres|mysql|mongodb|redis)://[^\x20\x09-\x0D"'<>]{4,}"""

#: Kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "ident", "key", "endpoint")


def matches(text: Column, pattern: str, kind: str, group: int = 0, least: int = 0) -> Column:
    """Array of (rank, i, gap, len, fine) of the i-th match: characters between it and the one before, its length,
    and whether its ``group`` has at least ``least`` characters."""
    rank = KINDS.index(kind)
    empty = F.expr("CAST(array() AS array<struct<rank:int,i:int,gap:int,len:int,fine:boolean>>)")

    def placed(m: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(m))
        inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else m
        rows = F.arrays_zip(F.transform(gaps, lambda p: F.length(p)).alias("gap"), F.transform(m, lambda x: F.length(x)).alias("len"), F.transform(inner, lambda x: F.length(x) >= least).alias("fine"))
        return F.transform(rows, lambda x, i: F.struct(F.lit(rank).alias("rank"), i.alias("i"), x["gap"].alias("gap"), x["len"].alias("len"), x["fine"].alias("fine")))

    return F.when(text.rlike(pattern), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)).otherwise(empty)


def _keyed(docs: DataFrame, keep: tuple[str, ...], text: str, key: str) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(*keep, F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_k1"), F.xxhash64(F.col(key), F.col(text)).alias("_k2"), t.alias("_t"))


_ROW = ["_k1", "_k2"]


def _spans(rows: DataFrame, scope: int) -> DataFrame:
    """(_k1, _k2, start, rank, end, kind, weak): base spans, and those that linking adds."""
    t = F.col("_t")
    fine = lambda c: F.exists(c, lambda x: x["fine"])
    rows = rows.select(*_ROW, "_t", matches(t, ASSIGN, "assign", 1, 8).alias("assign"), matches(t, ACCESS, "access").alias("access"), matches(t, HEX, "hex").alias("hex"), matches(t, IDENT, "ident").alias("ident"))
    none = F.slice("hex", 1, 0)
    has_id = (F.size("ident") > 0) | (F.size("access") > 0)
    rows = rows.withColumn("key", F.when(has_id, matches(t, KEY, "key")).otherwise(none))
    has_key = (F.size("key") > 0) | fine("assign") | (F.size("hex") > 0)
    rows = rows.withColumn("endpoint", F.when(has_id & has_key, matches(t, ENDPOINT, "endpoint")).otherwise(none))
    weak = F.when(has_id & has_key, F.concat("ident", "key", "endpoint")).otherwise(none)
    found = table(rows.select(*_ROW, F.inline(F.concat("assign", "access", "hex", weak))).distinct(), "secret-matches")
    # A match ends where all gaps and matches of its kind up to it do.
    end = F.sum(F.col("gap") + F.col("len")).over(W.partitionBy(*_ROW, "rank").orderBy("i")).cast("int")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("rank") + 1)
    parts = found.withColumn("end", end).where("fine").select(*_ROW, (F.col("end") - F.col("len")).alias("start"), "rank", "end", kind.alias("kind"))
    parts = table(parts, "secret-parts")
    kind = F.col("kind")
    side = F.when(kind.isin("access", "ident"), "id").when(kind.isin("assign", "hex", "key"), "key")
    offers = parts.select(*_ROW, F.col("start").alias("at"), side.alias("side")).where("side IS NOT NULL").withColumn("bucket", F.floor(F.col("at") / scope))
    # A weak part needs a part of the other side in its scope; endpoints need both sides.
    needs = F.when(kind == "ident", F.array(F.lit("key"))).when(kind == "key", F.array(F.lit("id"))).when(kind == "endpoint", F.array(F.lit("id"), F.lit("key")))
    weak = parts.withColumn("needs", needs).where("needs IS NOT NULL").withColumn("n_needs", F.size("needs"))
    probe = weak.withColumn("side", F.explode("needs")).drop("needs").withColumn("bucket", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col("start") / scope) + d)))
    met = probe.alias("p").join(offers.alias("o"), (F.col("p._k1") == F.col("o._k1")) & (F.col("p._k2") == F.col("o._k2")) & (F.col("p.side") == F.col("o.side")) & (F.col("p.bucket") == F.col("o.bucket")) & (F.abs(F.col("p.start") - F.col("o.at")) <= scope), "left_semi")
    linked = met.groupBy(*_ROW, "start", "rank", "end", "kind", "n_needs").agg(F.count_distinct("side").alias("met")).where("met = n_needs")
    base = parts.where(kind.isin("assign", "access", "hex")).withColumn("weak", F.lit(False))
    return base.unionByName(linked.select(*_ROW, "start", "rank", "end", "kind", F.lit(True).alias("weak")))


def scan(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", key: str = "doc_id", scope: int = SCOPE) -> DataFrame:
    """``keep`` columns and ``base`` and ``linked``: arrays of (start, rank, end, kind) in order of start, rank."""
    rows = _keyed(docs, keep, text, key)
    span = F.struct("start", "rank", "end", "kind")
    lists = [F.sort_array(F.collect_list(F.when(F.col("weak") == w, span))).alias(name) for w, name in ((False, "base"), (True, "linked"))]
    found = _spans(rows, scope).groupBy(*_ROW).agg(*lists)
    none = F.expr("CAST(array() AS array<struct<start:int,rank:int,end:int,kind:string>>)")
    out = rows.drop("_t").join(found, _ROW, "left")
    return out.select(*keep, F.coalesce("base", none).alias("base"), F.coalesce("linked", none).alias("linked"))


def listed(array: Column) -> Column:
    return F.array_join(F.transform(array, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


#: Stretches to cut from a text up to which each is cut by its position; longer lists go character by character.
MANY_CUTS = 64


def redact(docs: DataFrame, mark: str = "[SECRET]", scope: int = SCOPE) -> DataFrame:
    """The rows of ``docs`` with each span, base or linked, replaced by ``mark`` (spans that overlap by one);
    n_chars follows the text."""
    names = docs.columns
    row = F.struct(*[F.col(f"`{n}`") for n in names]).alias("_row")
    rows = _keyed(docs.select(row, F.col("doc_id"), F.col("text")), ("_row",), "text", "doc_id")
    # Spans that overlap an earlier one go on as its stretch.
    order = W.partitionBy(*_ROW).orderBy("start", "end")
    spans = _spans(rows, scope).withColumn("_to", F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1)))
    spans = spans.withColumn("_n", F.sum(F.when(F.col("start") < F.col("_to"), 0).otherwise(1)).over(order))
    cuts = spans.groupBy(*_ROW, "_n").agg(F.min("start").alias("at"), F.max("end").alias("to"))
    cuts = cuts.groupBy(*_ROW).agg(F.sort_array(F.collect_list(F.struct("at", "to"))).alias("_cuts"))
    text, cut = F.col("_row.text"), F.col("_cuts")
    # Kept pieces: from the end of each cut, and from 0, to the next cut or the end.
    pieces = F.transform(F.concat(F.array(F.struct(F.lit(0).alias("at"), F.lit(0).alias("to"))), cut), lambda c, i: F.struct(c["to"].alias("at"), F.coalesce(F.get(cut, i)["at"], F.length(text)).alias("to")))
    joined = lambda piece: F.array_join(F.transform(pieces, piece), mark)
    few = joined(lambda p: F.substring(text, p["at"] + 1, p["to"] - p["at"]))
    many = let(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), lambda chars: joined(lambda p: F.array_join(F.slice(chars, p["at"] + 1, p["to"] - p["at"]), "")))
    out = rows.drop("_t").join(cuts, _ROW, "left")
    out = out.select("_row", F.when(cut.isNull(), text).when(F.size(cut) > MANY_CUTS, many).otherwise(few).alias("_text"))
    put = [F.col("_text").alias("text") if n == "text" else F.length("_text").cast("long").alias(n) if n == "n_chars" else F.col(f"_row.`{n}`").alias(n) for n in names]
    return out.select(*put)
