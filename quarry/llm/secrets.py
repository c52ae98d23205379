"""Secret scans with multipart credential linking.

Each text is scanned once for the parts of a credential: identifiers, secrets and
endpoints. Parts become small rows; windows over their start positions join every part
with those of its scope, by the gap from the end of one part to the start of the next. Strong forms (an assignment to a secret name, an access key,
a long hex run) always count. Weak forms (a bare identifier, an opaque token, an endpoint)
count only where the parts that complete a credential lie within the scope.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import text_of

#: Kind, role, pattern, group whose length counts, least length of it.
STRONG = (
    ("assign", "secret", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "id", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", "secret", r"[0-9a-f]{24,}", 0, 24),
)
WEAK = (
    ("ident", "id", r"""(?i)\b(user|username|login|client_id|account_id|access_key_id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]+)""", 2, 3),
    ("opaque", "secret", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}", 0, 20),
    ("endpoint", "endpoint", r"""\b(?:https?|ftp|ssh|s3|redis|mongodb|mysql|postgresql|jdbc:[a-z]+)://[^\s"'<>]+""", 0, 10),
)
KINDS = [k[0] for k in STRONG + WEAK]
OPAQUE = KINDS.index("opaque")
#: An opaque token holds one of each; asked of a hit, not at every place of a text.
MIXED = ("[0-9]", "[A-Z]", "[a-z]")
ROLES = ("secret", "id", "endpoint")
PART = "array<struct<kind:int,role:string,rank:int,gap:bigint,size:bigint,holds:boolean>>"


def _parts(text: Column, order: int, role: str, pattern: str, group: int, least: int) -> Column:
    """All leftmost matches of one kind: order, role, rank, length of the gap before, length, whether long enough."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    mixed = lambda hit: functools.reduce(Column.__and__, [hit.rlike(m) for m in MIXED if order == OPAQUE], F.lit(True))
    counted = (lambda hit: hit) if group == 0 else (lambda hit: F.regexp_extract(hit, pattern, group))
    # zipped, so that a text is cut once and not once for each hit
    found = F.transform(
        F.filter(F.arrays_zip(hits.alias("hit"), gaps.alias("gap")), lambda x: x["hit"].isNotNull()),
        lambda x, i: F.struct(
            F.lit(order).alias("kind"),
            F.lit(role).alias("role"),
            i.alias("rank"),
            F.length(x["gap"]).cast("long").alias("gap"),
            F.length(x["hit"]).cast("long").alias("size"),
            ((F.length(counted(x["hit"])) >= least) & mixed(x["hit"])).alias("holds"),
        ),
    )
    return F.when(text.rlike(pattern), found)


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 200) -> DataFrame:
    """Spans of secrets in whole texts, one row per span, and one with null kind where there is none.

    Returns row (tells repeated rows apart), doc_id, span (start, kind as index into KINDS, end,
    strong; code points, end exclusive) and link. ``scope`` is the largest gap between two parts,
    from the end of one to the start of the other, within which they complete each other. Null and empty texts have no spans. A weak part
    that overlaps a strong one is left to the strong one. ``link`` says for a secret which
    identifier and which endpoint within the scope are nearest (of equal ones the one before);
    it is null where there is neither. Repeated rows keep their spans each. Other columns are not read.
    """
    kinds = [_parts(F.col("__text"), i, role, *rest) for i, (_, role, *rest) in enumerate(STRONG + WEAK)]
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), text_of(text_col).alias("__text"))
    rows = rows.select("row", "doc_id", F.concat(*[F.coalesce(k, F.array().cast(PART)) for k in kinds]).alias("__parts"))
    # one part of no kind for every text, so that a text whose parts all fall away keeps its row
    none = F.array(F.struct(F.lit(None).alias("kind"), F.lit(None).alias("role"), F.lit(0).alias("rank"), F.lit(0).alias("gap"), F.lit(0).alias("size"), F.lit(False).alias("holds"))).cast(PART)
    rows = rows.select("row", "doc_id", F.explode(F.concat("__parts", none)).alias("p")).select("row", "doc_id", "p.*")

    walked = Window.partitionBy("row", "kind").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(walked)).withColumn("start", F.col("end") - F.col("size"))
    rows = rows.filter(F.col("holds") | F.col("kind").isNull())

    strong = F.col("kind") < len(STRONG)
    by_start = Window.partitionBy("row").orderBy("start")
    before = by_start.rangeBetween(Window.unboundedPreceding, 0)
    # the parts that start no earlier, read from the last: a frame that ends unbounded is read anew for each row
    after = Window.partitionBy("row").orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, 0)
    # a part that starts no later is near if its end is; of those that start no earlier, the first is the nearest
    # (of two that end or start alike, the longer); a part does not complete itself, as it has another role
    of = lambda role, *order: F.when(F.col("role") == role, F.struct(*order, "kind"))
    back = lambda role: F.max(of(role, "end", (-F.col("start")).alias("start"))).over(before)
    ahead = lambda role: F.min(of(role, "start", (-F.col("end")).alias("end"))).over(after)
    for role in ROLES:
        rows = rows.withColumns({f"back_{role}": back(role), f"ahead_{role}": ahead(role)})
    near = lambda role: (F.col("start") - F.col(f"back_{role}.end"), F.col(f"ahead_{role}.start") - F.col("end"))
    # greatest would pass over a null
    apart = lambda g: F.when(g > 0, g).when(g <= 0, 0).otherwise(2**62)
    gap = {role: F.least(*map(apart, near(role))) for role in ROLES}
    seen = {role: gap[role] <= scope for role in ROLES}
    covered = (F.max(F.when(strong, F.col("end"))).over(before) > F.col("start")) | (F.min(F.when(strong, F.col("start"))).over(after) < F.col("end"))
    completed = (
        F.when(F.col("role") == "secret", seen["id"] | seen["endpoint"])
        .when(F.col("role") == "id", seen["secret"])
        .when(F.col("role") == "endpoint", seen["id"] & seen["secret"])
    )
    rows = rows.withColumns({"strong": strong, "linked": completed & ~F.coalesce(covered, F.lit(False))})
    span = F.when(F.col("strong") | F.col("linked"), F.struct("start", "kind", "end", "strong"))

    def partner(role: str) -> Column:
        """The nearest part of a role within the scope; of two as near, the one before."""
        first, then = F.col(f"back_{role}"), F.col(f"ahead_{role}")
        earlier = apart(near(role)[0]) <= apart(near(role)[1])
        told = F.when(earlier, F.struct(first["kind"].alias("kind"), (-first["start"]).alias("start"), first["end"].alias("end")))
        told = told.otherwise(F.struct(then["kind"].alias("kind"), then["start"].alias("start"), (-then["end"]).alias("end")))
        return F.when(seen[role], told).alias(role)

    # a credential: a reported secret with the identifier and the endpoint nearest to it
    whole = (F.col("role") == "secret") & (F.col("strong") | F.col("linked")) & (seen["id"] | seen["endpoint"])
    link = F.when(whole, F.struct(F.struct("start", "kind", "end").alias("secret"), partner("id"), partner("endpoint")))
    return rows.select("row", "doc_id", span.alias("span"), link.alias("link"))


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 200) -> DataFrame:
    """One row per document: counts by strong kind, spans, how many weak parts were linked, and the links.

    links lists credentials by their secret, as secret+identifier+endpoint without those that
    are missing. Null and empty texts have no spans, an empty table gives no rows, repeated
    rows repeat, and texts are read whole at any length.
    """
    spans = secret_spans(docs, id_col, text_col, scope)
    found = F.array_sort(F.collect_list("span"))
    named = F.array(*[F.lit(k) for k in KINDS])
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", F.get(named, s["kind"]), s["start"], s["end"])), ",")
    said = lambda s: F.when(s.isNotNull(), F.concat_ws(":", F.get(named, s["kind"]), s["start"], s["end"]))
    links = F.transform(F.array_sort(F.collect_list("link")), lambda x: F.concat_ws("+", *[said(x[r]) for r in ROLES]))
    links = F.array_join(links, ",").alias("links")
    counts = [F.count_if(F.col("span.kind") == i).alias(f"n_{k}") for i, (k, *_) in enumerate(STRONG)]
    rows = spans.groupBy("row", "doc_id").agg(found.alias("__found"), links, *counts)
    base = F.filter("__found", lambda s: s["strong"])
    linked = F.size(F.filter("__found", lambda s: ~s["strong"])).cast("long").alias("n_linked")
    return rows.select("doc_id", *[f"n_{k}" for k, *_ in STRONG], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("__found")).alias("spans"), linked, "links")
