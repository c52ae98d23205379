"""Packages of stories held against their evidence, units and coverage: the first failure of each package."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.stories import story_faults
from quarry.sources.work import written

#: Labels that say nothing of a phase, the form of a label, kinds of events by nobody.
GENERIC_PHASES = ("project evolution", "project update", "workflow progress", "项目演进", "项目更新", "工作流进展", "general work", "other", "later stage")
PHASE_LABEL = r"^[A-Za-z0-9]+(?:[-'][A-Za-z0-9]+)*(?:\s+[A-Za-z0-9]+(?:[-'][A-Za-z0-9]+)*)?$"
NOBODY = ("action_label", "artifact", "version_control", "git", "agent_event", "user_event", "system")

_REF = "struct<documentId:string,eventId:string>"
_MANIFEST = "struct<revision:double,digest:string>"
STORY = (
    f"struct<key:string,languagePolicyDigest:string,phase:struct<id:string,label:string>,people:array<struct<evidence:array<{_REF}>>>,story:struct<blocks:array<struct<id:string,evidence:array<{_REF}>>>>,"
    f"insights:array<struct<anchorStoryBlockId:string,quote:struct<text:string,evidence:{_REF}>,evidence:array<{_REF}>>>,evidence:struct<primary:{_REF},supporting:array<{_REF}>>,"
    f"coverage:struct<semanticManifest:{_MANIFEST},coverageManifest:{_MANIFEST},representedUnitIds:array<string>,excludedUnits:array<struct<unitId:string,reason:string>>>>"
)


def actor(actor_type: Column, event_type: Column, actor_id: Column) -> Column:
    """Who speaks or acts in a row of evidence; empty for tools, systems and recorded actions."""
    kind, event = F.lower(F.trim(F.coalesce(actor_type, F.lit("")))), F.lower(F.trim(F.coalesce(event_type, F.lit(""))))
    nobody = kind.isin("tool", "system") | event.isin(*NOBODY) | event.rlike("^tool(_|$)") | event.rlike("[_ ]action$")
    return F.when(nobody | (F.trim(F.coalesce(actor_id, F.lit(""))) == ""), "").otherwise(actor_id)


def _key(ref: Column) -> Column:
    return F.to_json(F.struct(ref["documentId"].alias("d"), ref["eventId"].alias("e")))


def package_codes(chapters: DataFrame, evidence: DataFrame, units: DataFrame, coverage: DataFrame, manifests: DataFrame, prefix: str = "story:") -> DataFrame:
    """(package, code, place): the first failure of each package and its chapter; both null where there is none.

    chapters: package, place (their order), id, document_id, summary; evidence: package, document_id, event_id, actor_type,
    event_type, actor_id, narrative; units: package, unit_id, member; coverage: package, unit_id, disposition, owner_id,
    reason; manifests: package, semantic_revision, semantic_digest, coverage_revision, coverage_digest, covers_revision,
    covers_digest. Packages without a manifest are held against their evidence alone. A null summary is no
    chapter. Of an event id that repeats in a package the smallest document counts. A chapter is one row, whatever it
    cites; packages, evidence and units of any size are only joined and grouped. Other columns are not read.
    """
    found: list[DataFrame] = []

    def fault(rows: DataFrame, stage: int, cases: list[tuple[int, Column | None, Column | str]], place: str = "place", pos: Column | int = 0) -> None:
        """The first of the cases (step, when, code) that a row meets."""
        at = F.col(place).cast("long") if place else F.lit(None).cast("long")
        pos = (pos if isinstance(pos, Column) else F.lit(pos)).cast("long").alias("pos")
        ranks = []
        for step, when, code in cases:
            code = code if isinstance(code, Column) else F.lit(code)
            rank = F.struct(F.lit(stage).alias("stage"), at.alias("place"), F.lit(step).alias("step"), pos, code.alias("code"))
            ranks.append(F.when(code.isNotNull() if when is None else when, rank))
        found.append(rows.select("package", F.coalesce(*ranks).alias("rank")).filter("rank is not null"))

    packages = reduce(DataFrame.union, (t.select("package") for t in (chapters, evidence, manifests))).distinct()
    fault(packages.join(chapters.select("package"), "package", "left_anti"), 0, [(0, None, "STORY_CANDIDATE_MISSING")], "")

    # the authority itself
    bound = manifests.select("package", "semantic_revision", "semantic_digest", "coverage_revision", "coverage_digest", "covers_revision", "covers_digest")
    rows_of = coverage.groupBy("package").agg(F.count("*").alias("n_rows"), F.count_distinct("unit_id").alias("n_ids"))
    units_of = units.groupBy("package").agg(F.count_distinct("unit_id").alias("n_units"))
    counted = bound.join(rows_of, "package", "left").join(units_of, "package", "left").fillna(0, ["n_rows", "n_ids", "n_units"])
    same = F.col("covers_revision").eqNullSafe(F.col("semantic_revision")) & F.col("covers_digest").eqNullSafe(F.col("semantic_digest"))
    fault(counted, 1, [(0, ~same | F.expr("n_rows <> n_ids or n_ids <> n_units"), "STORY_SEMANTIC_AUTHORITY_STALE")], "")
    held = bound.select("package")
    fault(units.select("package", "unit_id").distinct().join(held, "package", "left_semi").join(coverage, ["package", "unit_id"], "left_anti"), 1, [(1, None, "STORY_COVERAGE_INVALID")], "")

    # each chapter alone, and against those before it
    read = story_faults(chapters.select("package", "place", "id", "document_id", "summary"), "summary", prefix=prefix)
    # read and checked once; all that follows are joins and groups of it
    read = written(read.withColumn("s", F.from_json(F.substr("summary", F.lit(len(prefix) + 1)), STORY)).drop("summary"), "chapters")
    good = F.coalesce(F.size("faults") == 0, F.lit(False))
    primary = F.col("s.evidence.primary")
    elsewhere = ~F.col("id").eqNullSafe(primary["eventId"]) | ~F.col("document_id").eqNullSafe(primary["documentId"])
    fault(read, 2, [(1, ~good, "STORY_CHAPTER_INVALID"), (2, elsewhere, "STORY_EVIDENCE_INVALID")])
    told = read.filter(good).drop("faults")
    order = Window.partitionBy("package").orderBy("place")
    manifest = lambda m: F.concat_ws(":", F.col(f"s.coverage.{m}.revision").cast("long"), F.col(f"s.coverage.{m}.digest"))
    label = F.regexp_replace("s.phase.label", r"^\s+|\s+$", "")
    line = told.select(
        "package", "place", F.col("s.key").alias("key"), F.col("s.languagePolicyDigest").alias("policy"), manifest("semanticManifest").alias("semantic"), manifest("coverageManifest").alias("covered"), F.col("s.phase.id").alias("phase"), label.alias("label"),
    )
    line = line.withColumns({f"last_{c}": F.lag(c).over(order) for c in ("policy", "semantic", "covered", "phase")})
    line = line.withColumn("nth_key", F.row_number().over(Window.partitionBy("package", "key").orderBy("place")))
    named = Window.partitionBy("package", "phase").orderBy("place")
    line = line.withColumns({"nth_phase": F.row_number().over(named), "first_label": F.first("label").over(named)})
    wanted = bound.select("package", F.concat_ws(":", F.col("semantic_revision").cast("long"), "semantic_digest").alias("want"), F.concat_ws(":", F.col("coverage_revision").cast("long"), "coverage_digest").alias("want_covered"))
    plain = F.trim(F.regexp_replace(F.lower("label"), r"[^a-z0-9\p{L}]+", " "))
    says_nothing = ~F.col("label").rlike(PHASE_LABEL) | plain.isin(*GENERIC_PHASES) | (F.col("label") != F.col("first_label"))
    fault(line.join(wanted, "package", "left"), 2, [
        (3, F.expr("nth_key > 1"), "STORY_KEY_DUPLICATED"),
        (4, F.expr("policy <> last_policy"), "STORY_LANGUAGE_INVALID"),
        (5, F.expr("semantic <> last_semantic or covered <> last_covered or semantic <> want or covered <> want_covered"), "STORY_SEMANTIC_AUTHORITY_STALE"),
        (7, says_nothing, "STORY_PHASE_INVALID"),
        (8, F.expr("nth_phase > 1 and phase <> last_phase"), "STORY_PHASE_ORDER_INVALID"),
    ])

    # declared units: once in a package, as the coverage has them
    declared = F.concat(
        F.transform("s.coverage.representedUnitIds", lambda u: F.struct(u.alias("unit_id"), F.lit("represented").alias("as"), F.lit(None).cast("string").alias("why"))),
        F.transform("s.coverage.excludedUnits", lambda u: F.struct(u["unitId"].alias("unit_id"), F.lit("excluded").alias("as"), u["reason"].alias("why"))),
    )
    declared = told.select("package", "place", F.col("s.key").alias("key"), F.posexplode(declared).alias("pos", "u")).select("package", "place", "key", "pos", "u.*")
    again = declared.withColumn("nth", F.row_number().over(Window.partitionBy("package", "unit_id").orderBy("place", "pos")))
    again = written(again.join(held.withColumn("held", F.lit(True)), "package", "left"), "declared")
    known = units.select("package", "unit_id").distinct().join(coverage.select("package", "unit_id", "disposition", "owner_id", "reason"), ["package", "unit_id"])
    agrees = (F.col("disposition") == F.col("as")) & F.when(F.col("as") == "represented", F.col("owner_id").eqNullSafe(F.col("key"))).otherwise(F.col("reason").eqNullSafe(F.col("why")))
    fault(again.join(known, ["package", "unit_id"], "left"), 2, [(6, F.expr("nth > 1") | (F.col("held") & ~F.coalesce(agrees, F.lit(False))), "STORY_COVERAGE_INVALID")])
    declared = again.filter("held")
    ours = declared.select("package", "unit_id", F.lit(True).alias("ours"))
    theirs = coverage.join(held, "package", "left_semi").select("package", "unit_id", F.lit(True).alias("theirs"))
    fault(ours.join(theirs, ["package", "unit_id"], "full"), 3, [(0, F.expr("ours is null or theirs is null"), "STORY_COVERAGE_INVALID")], "")

    # what a chapter cites
    item = F.struct("document_id", actor(F.col("actor_type"), F.col("event_type"), F.col("actor_id")).alias("actor"), "narrative")
    items = evidence.groupBy("package", "event_id").agg(F.min_by(item, "document_id").alias("item"))
    barred = units.join(held, "package", "left_semi").join(coverage.filter("disposition = 'excluded'").select("package", "unit_id"), ["package", "unit_id"]).select("package", F.col("member").alias("event_id"), F.lit(True).alias("barred")).distinct()
    refs = told.select("package", "place", F.posexplode(F.concat(F.array("s.evidence.primary"), "s.evidence.supporting")).alias("pos", "ref")).withColumn("event_id", F.col("ref.eventId"))
    refs = refs.join(items, ["package", "event_id"], "left").join(barred, ["package", "event_id"], "left")
    there = F.coalesce(F.col("item.document_id") == F.col("ref.documentId"), F.lit(False))
    refs = written(refs.select("package", "place", "pos", "ref", there.alias("there"), "barred", F.col("item.actor").alias("actor")), "references")
    fault(refs, 2, [(9, ~F.col("there"), "STORY_EVIDENCE_INVALID"), (9, F.col("barred"), "STORY_EXCLUDED_EVIDENCE_INVALID")], pos=F.col("pos"))
    cited = refs.filter("there").groupBy("package", "place").agg(F.map_from_entries(F.collect_set(F.struct(_key(F.col("ref")).alias("key"), F.col("actor")))).alias("cites"))
    told = told.join(cited, ["package", "place"])
    outside = lambda refs: F.exists(refs, lambda r: ~F.map_contains_key("cites", _key(r)))
    actors = lambda refs: F.array_distinct(F.transform(refs, lambda r: F.coalesce(F.element_at("cites", _key(r)), F.lit(""))))
    blocks, people, insights = F.col("s.story.blocks"), F.col("s.people"), F.col("s.insights")
    of_blocks = F.flatten(blocks["evidence"])
    told = told.withColumn("required", F.array_remove(actors(of_blocks), "")).withColumn("by_person", F.transform(people, lambda p: actors(p["evidence"])))
    every = F.flatten("by_person")
    one = F.forall("by_person", lambda a: (F.size(a) == 1) & F.array_contains(F.col("required"), F.get(a, F.lit(0))))
    right = (F.size(people) > 0) & (F.size("required") > 0) & ~F.exists(people, lambda p: outside(p["evidence"])) & one
    right &= (F.size(F.array_distinct(every)) == F.size(every)) & (F.size(F.array_except("required", every)) == 0)
    anchored = lambda i: F.exists(blocks, lambda b: (b["id"] == i["anchorStoryBlockId"]) & F.exists(b["evidence"], lambda r: _key(r) == _key(i["quote"]["evidence"])))
    grounded = lambda i: F.map_contains_key("cites", _key(i["quote"]["evidence"])) & anchored(i) & ~outside(i["evidence"])
    fault(told, 2, [(10, outside(of_blocks), "STORY_EVIDENCE_INVALID"), (11, ~right, "STORY_PEOPLE_INVALID"), (12, ~F.forall(insights, grounded), "STORY_INSIGHT_GROUNDING_INVALID")])
    quotes = told.select("package", "place", F.explode(insights["quote"]).alias("q")).select("package", "place", F.col("q.text").alias("quote"), F.col("q.evidence.eventId").alias("event_id"))
    says = F.coalesce(F.contains(F.col("item.narrative"), F.col("quote")), F.lit(False))
    fault(quotes.join(items, ["package", "event_id"], "left").withColumn("says", says), 2, [(12, ~F.col("says"), "STORY_INSIGHT_GROUNDING_INVALID")])
    spoken = F.concat(of_blocks, F.flatten(people["evidence"]), insights["quote"]["evidence"], F.flatten(insights["evidence"]))["eventId"]
    spoken = told.select("package", "place", F.explode(F.array_distinct(spoken)).alias("member")).join(units, ["package", "member"]).select("package", "place", "unit_id")
    silent = declared.filter(F.col("as") == "represented").join(told.select("package", "place"), ["package", "place"], "left_semi")
    fault(silent.join(spoken, ["package", "place", "unit_id"], "left_anti"), 2, [(13, None, "STORY_COVERAGE_INVALID")])

    first = reduce(DataFrame.unionAll, found).groupBy("package").agg(F.min("rank").alias("rank"))
    return packages.join(first, "package", "left").select("package", F.col("rank.code").alias("code"), F.col("rank.place").alias("place"))
