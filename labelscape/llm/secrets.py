"""Secret scan with linking of multipart credentials (operator 7), in DataFrame functions only.

Strong patterns are reported wherever they match. Weak ones (an account name, a bare random-looking run, an address)
mean nothing alone; they are reported only if parts that complete each other lie within reach: a secret with an
identifier or an endpoint. Finding those is an interval join, done on stretches of text of one reach, so that
a join key holds no more parts than fit into one stretch.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelscape.llm.common import columns_of, unused, written


@dataclass(frozen=True)
class Kind:
    """A pattern, the role of what it finds, whether that counts alone, and the least length of one of its groups."""

    name: str
    pattern: str
    role: str
    strong: bool
    group: int = 0
    least: int = 1


KINDS = (
    Kind("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         "secret", True, 2, 12),
    Kind("access", r"AKIA[A-Z0-9]+", "identifier", True, 0, 18),
    Kind("hex", r"[0-9a-f]{16,}", "secret", True),
    Kind("account", r"""(?i:user(?:_?name|_?id)?|login|account|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}"""
                    r"""|(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+""", "identifier", False),
    Kind("bare", r"(?<![A-Za-z0-9+/_-])(?=[A-Z0-9+/_-]*[a-z])(?=[a-z0-9+/_-]*[A-Z])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{20,}={0,2}",
         "secret", False),
    Kind("endpoint", r"""[a-z][a-z0-9+.-]{1,15}://[^\s"'<>]{3,}|(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]{1,5})?(?![0-9.])""",
         "endpoint", False),
)
#: Rows without any of these hold no secret, strong or weak, and thus nothing to report.
ANY = r"(?i:password|passwd|secret|token|api_?key)|AKIA[A-Z0-9]{14}|[0-9a-f]{16}|[A-Za-z0-9+/_-]{20}"
#: Largest number of code points between two parts of one credential.
REACH = 200
#: Matches of one text are added up in runs of so many.
RUN = 1024
ROW = ["row_key", "row_hash"]


def hits(kind: Kind) -> Column:
    """Sizes of a kind's matches, and of the group that must reach the kind's least length."""
    def of(hit: Column) -> Column:
        told = F.regexp_extract(hit, kind.pattern, kind.group) if kind.group else hit
        return F.struct(F.char_length(hit).alias("size"), F.char_length(told).alias("told"))

    return F.transform(F.regexp_extract_all("text", F.lit(kind.pattern), F.lit(0)), of)


def matches(rows: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """Every match of every kind in ``text``: row_key, row_hash, kind, role, strong, start, end (code points).

    Positions are the running sum of the lengths of the matches and of the text between them.
    """
    listed = [F.struct(
        F.lit(i).alias("rank"),
        F.transform(F.split("text", k.pattern, -1), F.char_length).alias("between"),
        hits(k).alias("hits"))
        for i, k in enumerate(kinds)]
    found = rows.where(F.col("text").rlike(ANY)).select(*ROW, F.explode(F.array(*listed)).alias("k")).where(
        F.size("k.hits") > 0)
    each = found.select(*ROW, "k.rank", F.posexplode(F.arrays_zip("k.between", "k.hits")).alias("at", "hit")).where(
        "hit.hits is not null").select(
        *ROW, "rank", "at", (F.col("at") / RUN).cast("int").alias("run"), F.col("hit.hits.size").alias("size"),
        F.col("hit.hits.told").alias("told"), (F.col("hit.between") + F.col("hit.hits.size")).cast("long").alias("step"))
    # repeated rows have equal matches; written, since the patterns would else run anew for each use
    each = written(each.dropDuplicates([*ROW, "rank", "at"]))
    within = Window.partitionBy(*ROW, "rank", "run").orderBy("at")
    runs = each.groupBy(*ROW, "rank", "run").agg(F.sum("step").alias("total"))
    before = Window.partitionBy(*ROW, "rank").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(*ROW, "rank", "run", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    kind = F.array(*[F.struct(F.lit(k.name).alias("kind"), F.lit(k.role).alias("role"), F.lit(k.strong).alias("strong"),
                              F.lit(k.least).alias("least")) for k in kinds])
    placed = each.withColumn("here", F.sum("step").over(within)).join(
        runs.withColumnsRenamed({c: f"r_{c}" for c in [*ROW, "rank", "run"]}),
        F.col("row_key").eqNullSafe(F.col("r_row_key")) & (F.col("row_hash") == F.col("r_row_hash"))
        & (F.col("rank") == F.col("r_rank")) & (F.col("run") == F.col("r_run")))
    return placed.withColumn("k", F.element_at(kind, F.col("rank") + 1)).where("told >= k.least").select(
        *ROW, "rank", "k.kind", "k.role", "k.strong", (F.col("base") + F.col("here") - F.col("size")).alias("start"),
        (F.col("base") + F.col("here")).alias("end"))


def links(parts: DataFrame, reach: int = REACH) -> DataFrame:
    """Pairs of a secret and an identifier or endpoint of the same text with at most ``reach`` code points between them.

    Both are dealt to every stretch of ``reach`` code points that they (the secret with its reach) touch; a pair counts
    in the first stretch that both touch.
    """
    first = F.floor((F.greatest(F.col("start") - reach, F.lit(0))) / reach)
    secrets = parts.where("role = 'secret'").select(
        *[F.col(c).alias(f"s_{c}") for c in [*ROW, "rank", "start", "end"]], first.alias("s_from"),
        F.explode(F.sequence(first, F.floor((F.col("end") + reach) / reach))).alias("s_stretch"))
    own = F.floor(F.col("start") / reach)
    others = parts.where("role <> 'secret'").select(
        *[F.col(c).alias(f"o_{c}") for c in [*ROW, "rank", "role", "start", "end"]], own.alias("o_from"),
        F.explode(F.sequence(own, F.floor(F.col("end") / reach))).alias("o_stretch"))
    return secrets.join(
        others, F.col("s_row_key").eqNullSafe(F.col("o_row_key")) & (F.col("s_row_hash") == F.col("o_row_hash"))
        & (F.col("s_stretch") == F.col("o_stretch"))).where(
        (F.col("o_start") <= F.col("s_end") + reach) & (F.col("s_start") <= F.col("o_end") + reach)
        & (F.col("s_stretch") == F.greatest("s_from", "o_from")))


def reported(parts: DataFrame, reach: int = REACH) -> DataFrame:
    """Strong parts, and weak ones that a link completes."""
    linked = links(parts, reach)
    name = [*ROW, "rank", "start"]
    ends = linked.select(*[F.col(f"s_{c}").alias(f"l_{c}") for c in name]).union(
        linked.select(*[F.col(f"o_{c}").alias(f"l_{c}") for c in name])).distinct()
    weak = parts.where("not strong").join(
        ends, F.col("row_key").eqNullSafe(F.col("l_row_key")) & (F.col("row_hash") == F.col("l_row_hash"))
        & (F.col("rank") == F.col("l_rank")) & (F.col("start") == F.col("l_start")), "left_semi")
    return parts.where("strong").unionByName(weak)


def rows_of_text(docs: DataFrame, key: str, text: str) -> DataFrame:
    """row_key, row_hash and text of every row; rows equal in key and text share their matches."""
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(key).alias("row_key"), F.xxhash64(value).alias("row_hash"), value.alias("text"))


def scan(docs: DataFrame, *, key: str = "doc_id", text: str = "text", reach: int = REACH) -> DataFrame:
    """One row for each key and text that has a secret: row_key, row_hash and ``found``, an array of (start, rank, end, kind) in text order."""
    parts = written(matches(rows_of_text(docs, key, text)))
    return reported(parts, reach).groupBy(*ROW).agg(
        F.array_sort(F.collect_list(F.struct("start", "rank", "end", "kind"))).alias("found"))


def told(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secret_spans(docs: DataFrame, *, key: str = "doc_id", text: str = "text", reach: int = REACH) -> DataFrame:
    """Per row: key, n_assign, n_access, n_hex, base_sha256 and ``spans`` ("kind:start:end", comma-joined).

    A null or empty text has no spans; repeated rows stay, and a null key is a key like any other.
    """
    found = scan(docs, key=key, text=text, reach=reach).withColumnsRenamed({c: f"f_{c}" for c in ROW})
    rows = rows_of_text(docs, key, text).select(*ROW)
    spans = F.coalesce(F.col("found"), F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string>>"))
    base = len([k for k in KINDS if k.strong])

    def many(name: str) -> Column:
        return F.size(F.filter("all", lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")

    return rows.join(found, F.col("row_key").eqNullSafe(F.col("f_row_key")) & (F.col("row_hash") == F.col("f_row_hash")),
                     "left").withColumn("all", spans).select(
        F.col("row_key").alias(key), many("assign"), many("access"), many("hex"),
        F.sha2(told(F.filter("all", lambda s: s["rank"] < base)), 256).alias("base_sha256"), told(F.col("all")).alias("spans"))


def redact(docs: DataFrame, *, key: str = "doc_id", text: str = "text", mark: str = "[SECRET]",
           reach: int = REACH) -> DataFrame:
    """``docs`` with every reported span (overlapping ones as one) replaced by ``mark``; all rows and columns stay."""
    names = {c: unused(docs, f"f_{c}") for c in [*ROW, "gaps"]}
    found = scan(docs, key=key, text=text, reach=reach)
    merged = F.aggregate(
        "found", F.array().cast("array<struct<start:bigint,end:bigint>>"),
        lambda done, s: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["end"] >= s["start"]),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(
                F.element_at(done, -1)["start"].alias("start"),
                F.greatest(F.element_at(done, -1)["end"], s["end"]).alias("end")))))
        .otherwise(F.concat(done, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))))
    found = found.select(*[F.col(c).alias(names[c]) for c in ROW], merged.alias(names["gaps"]))
    gaps = F.col(names["gaps"])
    # pieces of text between the gaps, one more than there are gaps
    pieces = F.transform(F.sequence(F.lit(0), F.size(gaps)), lambda i: F.substring(
        F.col(text), (F.when(i > 0, F.get(gaps, i - 1)["end"]).otherwise(0) + 1).cast("int"),
        (F.when(i < F.size(gaps), F.get(gaps, i)["start"]).otherwise(F.char_length(text))
         - F.when(i > 0, F.get(gaps, i - 1)["end"]).otherwise(0)).cast("int")))
    own = F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))
    # a text without any of the patterns stays where it is
    some = F.coalesce(F.col(text).rlike(ANY), F.lit(False))
    rest, docs = docs.where(~some), docs.where(some)
    return rest.unionByName(docs.join(found, docs[key].eqNullSafe(F.col(names["row_key"])) & (own == F.col(names["row_hash"])), "left").withColumn(
        text, F.when(gaps.isNotNull(), F.array_join(pieces, mark)).otherwise(F.col(text))).select(*columns_of(docs)))
