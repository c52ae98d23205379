"""Records as canonical JSON, their digests, and what identifies or names them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Record ids that only say where a record stood, and file names that are never copied.
POSITIONAL_ID = r"^line-[0-9]+(:[0-9]+)?$"
SENSITIVE_NAME = r"(?i)(auth\.json|\.credentials\.json|credentials|\.env(\.|$)|id_rsa|id_ed25519|id_ecdsa|\.pem$|\.key$|token|secret|password|\.netrc|\.npmrc|\.pypirc)"


def sensitive_name(path: Column) -> Column:
    """Whether a file's own name, not its folders, tells of secrets."""
    return F.regexp_extract(path, r"[^/]*$", 0).rlike(SENSITIVE_NAME)


def canonical(**fields: Column | str) -> Column:
    """The fields as compact JSON, keys in byte order, nulls kept, letters not escaped."""
    parts = [(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in sorted(fields.items(), key=lambda kv: kv[0].encode())]
    return F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def ordered_digest(rows: DataFrame, by: list[str], order: list[str], line: Column) -> DataFrame:
    """Per group: the digest of its lines in order, each with a line break after it; bytes and lines. A group's lines must fit in a task."""
    packed = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*order, line.alias("line")))).alias("all"), F.sum(F.octet_length(line) + 1).alias("n_bytes"), F.count("*").alias("n_rows"))
    return packed.select(*by, digest(F.concat_ws("", F.transform("all", lambda x: F.concat(x["line"], F.lit("\n"))))).alias("digest"), "n_bytes", "n_rows")


def pseudonym(prefix: str, *scope: str) -> Column:
    """An opaque name, the same for equal scopes: prefix and a digest of the scope."""
    return F.concat(F.lit(f"{prefix}-"), digest(F.to_json(F.array(*[F.col(c).cast("string") for c in scope]))))


def stable_record_id(record_id: Column) -> Column:
    """A record's own id; null where it is blank or only a position."""
    return F.when((F.trim(record_id) != "") & ~record_id.rlike(POSITIONAL_ID), record_id)


def first_filled(*columns: str) -> Column:
    """The first of the columns that is neither null nor empty."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in columns])


def bounded_text(text: Column, most: int) -> Column:
    """Whether a text is filled, has at most ``most`` bytes and no control characters."""
    return F.coalesce((F.trim(text) != "") & (F.octet_length(text) <= most) & ~text.rlike(r"[\x00-\x1f\x7f]"), F.lit(False))


def location(path: Column) -> Column:
    """(kind, root, parts) of an absolute path; null for others. Drives and /mnt/<letter> fold case, . and .. are resolved."""
    windows = path.rlike(r"^[A-Za-z]:[\\/]")
    raw = F.when(windows, F.split(F.lower(F.substring(path, 4, 100_000)), r"[\\/]")).otherwise(F.split(F.substring(path, 2, 100_000), "/"))
    up = lambda done: F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
    parts = F.aggregate(raw, F.array().cast("array<string>"), lambda done, p: F.when(p.isin("", "."), done).when(p == "..", up(done)).otherwise(F.concat(done, F.array(p))))
    mounted = (F.get(parts, F.lit(0)) == "mnt") & F.get(parts, F.lit(1)).rlike("^[A-Za-z]$")
    make = lambda kind, root, p: F.struct(kind.alias("kind"), root.alias("root"), p.alias("parts"))
    drive = F.lower(F.substring(path, 1, 1))
    posix = F.when(mounted, make(F.lit("windows"), F.lower(F.get(parts, F.lit(1))), F.transform(F.slice(parts, 3, 100_000), F.lower)))
    posix = posix.otherwise(make(F.lit("posix"), F.lit(""), parts))
    return F.when(windows, make(F.lit("windows"), drive, parts)).when(path.rlike(r"^/(?!/)") & ~path.contains("\0"), posix)


def path_relation(here: Column, there: Column) -> Column:
    """How one location lies to another: exact, child, parent, sibling, unrelated, missing_unparseable."""
    a, b = here["parts"], there["parts"]
    starts = lambda long, short: (F.size(long) >= F.size(short)) & (F.slice(long, F.lit(1), F.size(short)) == short)
    shared = F.greatest(F.size(b) - 1, F.lit(0))
    beside = (F.size(b) > 0) & (F.size(a) >= shared) & (F.slice(a, F.lit(1), shared) == F.slice(b, F.lit(1), shared))
    same = (here["kind"] == there["kind"]) & (here["root"] == there["root"])
    known = F.when(~same, "unrelated").when(a == b, "exact").when(starts(a, b), "child").when(starts(b, a), "parent").when(beside, "sibling")
    return F.when(here.isNull() | there.isNull(), "missing_unparseable").otherwise(F.coalesce(known, F.lit("unrelated")))


def overlapping_ranges(text: Column, needle: Column) -> Column:
    """Starts (from 0) of every place where the needle stands, overlapping ones too."""
    last = F.length(text) - F.length(needle)
    at = F.filter(F.sequence(F.lit(0), last), lambda i: F.substr(text, i + 1, F.length(needle)) == needle)
    return F.when((F.length(needle) > 0) & (last >= 0), at).otherwise(F.array().cast("array<int>"))
