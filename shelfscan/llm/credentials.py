"""Credential spans in texts, told apart by corpus-wide ownership frequency.

Built from DataFrame functions only. Candidate values are hashed and counted over the whole
corpus by distinct repositories and owners: a value that many owners hold is a copied example,
one that few hold is specific to its owner and looks live. The counting is done in three
map-side combined steps, so a value that a third of all documents hold is never in one group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut

# Patterns of the base kinds, in the order of the kinds.
ASSIGN = (
    r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]"
    r"|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
# Runs are matched whole, so asking for the length in the pattern drops the same matches.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
OPAQUE = r"[A-Za-z0-9+/_-]{20,}"

KINDS = ("assign", "access", "hex", "opaque")
_SPAN = "struct<start:bigint,end:bigint,kind:int,value:string>"


def _spans(kind: int, pattern: str, value: str, keep: str) -> F.Column:
    """Spans of all matches, from the pieces between them; ``value``, ``keep``: SQL over x, v."""
    quoted = pattern.replace("\\", "\\\\").replace("'", "\\'")
    return F.expr(
        f"""filter(aggregate(
            zip_with(m_{kind}, slice(p_{kind}, 1, size(m_{kind})),
                     (m, p) -> named_struct('m', m, 'p', p)),
            named_struct('at', 0L, 'found', CAST(array() AS array<{_SPAN}>)),
            (acc, x) -> named_struct(
                'at', acc.at + length(x.p) + length(x.m),
                'found', concat(acc.found, array(named_struct(
                    'start', acc.at + length(x.p),
                    'end', acc.at + length(x.p) + length(x.m),
                    'kind', {kind},
                    'value', {value.format(pattern=quoted)})))),
            acc -> acc.found), v -> {keep})"""
    )


# Kind number -> pattern, value of a match, condition on a span. What stands before a pattern
# changes no match: it only lets the search pass quickly over places where none can begin.
_RULES = (
    (r"(?=[pPsStTaA])" + ASSIGN, "regexp_extract(x.m, '{pattern}', 2)", "length(v.value) >= 6"),
    (ACCESS, "x.m", "true"),
    (r"(?<![0-9a-f])" + HEX, "x.m", "true"),
    (
        r"(?<![A-Za-z0-9+/_-])" + OPAQUE,
        "x.m",
        "v.value RLIKE '[a-z]' AND v.value RLIKE '[A-Z]' AND v.value RLIKE '[0-9]'",
    ),
)
# Texts without these can hold no match of the kind.
_NEEDED = {0: "contains(text, ':') OR contains(text, '=')", 1: "contains(text, 'AKIA')"}


def candidates(docs: DataFrame) -> DataFrame:
    """``docs`` without text, with ``base`` and ``opaque``: arrays of spans by start, kind.

    Base spans are assign, access and hex; opaque ones are long tokens of mixed letters and
    digits that touch no base span. Positions are code points, the end exclusive.
    """
    rows = docs.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    for kind, (pattern, _, _) in enumerate(_RULES):
        rows = rows.withColumn(
            f"m_{kind}",
            F.when(
                F.expr(_NEEDED.get(kind, "true")),
                F.regexp_extract_all("text", F.lit(pattern), F.lit(0)),
            ).otherwise(F.array().cast("array<string>")),
        ).withColumn(f"p_{kind}", F.when(F.size(f"m_{kind}") > 0, F.split("text", pattern, -1)))
    none = F.array().cast(f"array<{_SPAN}>")
    found = rows.select(
        *[c for c in docs.columns if c != "text"],
        *[
            F.when(F.size(f"m_{kind}") > 0, _spans(kind, *rule)).otherwise(none).alias(f"s_{kind}")
            for kind, rule in enumerate(_RULES)
        ],
    )
    return found.withColumn("base", F.array_sort(F.concat("s_0", "s_1", "s_2"))).withColumn(
        "opaque",
        F.filter(
            "s_3",
            lambda o: ~F.exists("base", lambda b: (b["start"] < o["end"]) & (o["start"] < b["end"])),
        ),
    ).drop("s_0", "s_1", "s_2", "s_3")


def ownership(spans: DataFrame) -> DataFrame:
    """(value_hash, n_repositories, n_owners) over rows (value_hash, repository, owner)."""
    once = spans.groupBy("value_hash", "owner", "repository").agg(F.lit(1).alias("one"))
    owners = once.groupBy("value_hash", "owner").agg(F.count("repository").alias("r"))
    return owners.groupBy("value_hash").agg(
        F.sum("r").alias("n_repositories"), F.count("owner").alias("n_owners")
    )


def find_secrets(
    docs: DataFrame, repository: str, owner: str, example_owners: int = 3
) -> DataFrame:
    """One row per row of ``docs``: doc_id and ``spans``, an array by start and kind of
    (start, end, kind number, value_hash, n_repositories, n_owners, verdict).

    verdict is "example" for values that at least ``example_owners`` owners hold, else "live".
    Every base span is returned with its verdict; opaque spans only where they look live.
    ``repository`` and ``owner`` are SQL expressions over ``docs``; a pair repositories counts
    once per owner, nulls count as none. Null text is empty. Rows with equal or null doc_id are
    separate documents. Texts of any length are searched whole, in the memory of one task; columns
    beside those of the expressions, whatever their names, are ignored. An empty table gives an
    empty result.
    """
    parsed = cut(
        candidates(
            docs.select(
                F.col("doc_id").cast("long").alias("doc_id"),
                F.expr(owner).cast("string").alias("owner"),
                F.expr(repository).cast("string").alias("repository"),
                "text",
            )
        ).withColumn("row_", F.monotonically_increasing_id())
    )
    some = parsed.filter((F.size("base") > 0) | (F.size("opaque") > 0))
    spans = some.select(
        "row_", "doc_id", "owner", "repository", F.inline(F.concat("base", "opaque"))
    ).withColumn("value_hash", F.sha2("value", 256))
    held = ownership(spans.select("value_hash", "owner", "repository"))
    verdict = F.when(F.col("n_owners") >= example_owners, "example").otherwise("live")
    judged = (
        spans.join(held, "value_hash")
        .withColumn("verdict", verdict)
        .filter((F.col("kind") < KINDS.index("opaque")) | (F.col("verdict") == "live"))
    )
    span = F.struct(
        "start", "end", "kind", "value_hash", "n_repositories", "n_owners", "verdict"
    )
    gathered = judged.groupBy("row_").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    kind = gathered.schema["spans"].dataType
    with_any = some.select("row_", "doc_id").join(gathered, "row_", "left")
    without = parsed.filter((F.size("base") == 0) & (F.size("opaque") == 0)).select(
        "row_", "doc_id", F.lit(None).cast(kind).alias("spans")
    )
    return with_any.union(without).select(
        "doc_id", F.coalesce("spans", F.array().cast(kind)).alias("spans")
    )
