"""Queries over reviews and releases: span decisions, the gate, coverage, stories, questions, edits, stages and checks.

Orders stand for chapters, units and jobs, lines for spans, edits and members, customers for
owners and runs, parts for questions, suppliers for shards.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions import records as rec
from quarry.operators import authority, relate, spans
from quarry.plans.evidence import dealt, dealt_values
from quarry.sources.items import conversation_items, table

def picked(c, *values_):
    return F.get(F.array(*[F.lit(v) for v in values_]), (c % len(values_)).cast("int"))


def chapter_spans(spark, sf_dir):
    """Reviewed spans by chapter; every 31st chapter has a state that is not known, every 37th a status that does not fit."""
    key, n = F.col("l_orderkey"), F.col("l_linenumber")
    state = F.when((key % 31 == 0) & (n == 1), "odd").when(n % 4 == 3, "confirmed_keep").when((key % 5 == 0) & (n == 2), "needs_confirmation").otherwise(picked(n, "deterministic", "confirmed_redact"))
    status = F.when((key % 37 == 0) & (n == 1), "removed").when(state == "confirmed_keep", "removed").otherwise("active")
    return table(spark, sf_dir, "lineitem").select(key.alias("chapter"), n.alias("n"), state.alias("state"), status.alias("status"))


_SPANS = """spans as (select l_orderkey as chapter, l_linenumber as n, case when l_orderkey % 31 = 0 and l_linenumber = 1 then 'odd' when l_linenumber % 4 = 3 then 'confirmed_keep' when l_orderkey % 5 = 0 and l_linenumber = 2 then 'needs_confirmation' when l_linenumber % 2 = 0 then 'deterministic' else 'confirmed_redact' end as state from lineitem),
reviewed as (select chapter, count(*) as n_spans, case when bool_or(state = 'odd') then 'state_invalid' when bool_or((case when (chapter % 37 = 0 and n = 1) or state = 'confirmed_keep' then 'removed' else 'active' end) <> (case when state = 'confirmed_keep' then 'removed' else 'active' end)) then 'state_inconsistent' when bool_or(state = 'needs_confirmation') then 'pending' end as review_code from spans group by 1)"""


def g6_decision_states(spark, sf_dir):
    """What each span's state becomes by the decision that its line's flag stands for."""
    flags = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("chapter"), F.col("l_linenumber").alias("n"), F.when(F.col("l_returnflag") == "R", "redact").when(F.col("l_returnflag") == "A", "keep").otherwise("none").alias("decision"))
    found = chapter_spans(spark, sf_dir).join(flags, ["chapter", "n"]).withColumn("to", authority.decided(F.col("state"), F.col("decision")))
    return found.groupBy(F.coalesce("to.state", F.lit("not_actionable")).alias("result")).agg(F.count("*").alias("n_spans"))


def g7_release_gate(spark, sf_dir):
    """The first reason that keeps each chapter's privacy job from opening the release, null where it opens."""
    reviewed = authority.review_code(chapter_spans(spark, sf_dir), ["chapter"])
    k = F.col("o_orderkey")
    jobs = table(spark, sf_dir, "orders").join(reviewed, k == F.col("chapter"), "left").withColumns({
        "status": F.when(k % 41 != 0, F.when(k % 43 == 0, "running").otherwise("complete")), "rejected": (k % 47 == 0).cast("int"), "completed": F.coalesce("n_spans", F.lit(0)), "total": F.coalesce("n_spans", F.lit(0)) + (k % 53 == 0).cast("int"),
        "source_digest": F.when(k % 59 != 0, F.sha2(k.cast("string"), 256)), "receipt_digest": F.when(k % 61 != 0, F.sha2(F.concat(F.lit("r"), k), 256)).otherwise("x"), "source_revision": F.lit(2), "now_revision": F.lit(3), "now_digest": F.sha2((k + (k % 67 == 0).cast("int")).cast("string"), 256),
    })
    return jobs.select("o_orderkey", authority.release_code(jobs).alias("code"))


def g8_worker_coverage(spark, sf_dir):
    """Workers that say they read another number of turns than there are, or another text; all files are owed a report."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n"), 256).alias("digest"))
    c = F.col("conv_id")
    told = turns.filter(c % 13 != 1).select(c, (F.col("n") - (c % 7 == 0).cast("int")).alias("told_n"), F.when(c % 11 == 0, "stale").otherwise(F.col("digest")).alias("told_digest"))
    code = F.when(F.col("told_n").isNull(), "no_report").when(F.col("told_digest") != F.col("digest"), "digest").when(F.col("told_n") != F.col("n"), "turns")
    return turns.join(told, "conv_id", "left").select("conv_id", code.alias("code")).filter("code is not null")


SPANNED = [(1, "A😀秘密Z", 2, 4, "private-personal", "active"), (2, "keep this", 0, 4, "sensitive", "removed"), (3, "abcdef", 1, 4, "sensitive", None), (3, "abcdef", 3, 5, "credential", "active"), (4, "abc", 1, 9, "sensitive", "active"), (5, "abcdef", 0, 6, "BAD cat", "active"), (5, "abcdef", 2, 3, "inner", "active"), (6, "none", None, None, None, None)]
G4_WANT = [(1, 'A😀<redacted category="private-personal"/>Z'), (2, "keep this"), (3, 'a<redacted category="sensitive"/><redacted category="credential"/>f'), (4, None), (5, '<redacted category="sensitive"/>'), (6, "none")]


def g4_active_spans(spark, sf_dir):
    """Texts with their active spans as tags; a span out of range gives null."""
    rows = dealt(spark, sf_dir, SPANNED, "id int, text string, s int, e int, c string, status string")
    active = (F.coalesce("status", F.lit("active")) == "active") & F.col("s").isNotNull()
    bad = active & ~((F.col("s") >= 0) & (F.col("s") < F.col("e")) & (F.col("e") <= F.length("text")))
    category = F.when(F.col("c").rlike("^[a-z0-9][a-z0-9-]{0,63}$"), F.col("c")).otherwise("sensitive")
    found = rows.groupBy("id", "text").agg(F.collect_list(F.when(active, F.struct("s", "e", category.alias("c")))).alias("spans"), F.bool_or(bad).alias("bad"))
    return found.select("id", F.when(~F.col("bad"), spans.applied(F.col("text"), F.col("spans"))).alias("text"))


def g16_residuals(spark, sf_dir):
    """Per customer the wanted states that are still held, in order."""
    held = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("held"))
    return held.select("o_custkey", F.array_join(F.array_sort(F.array_intersect("held", F.array(F.lit("F"), F.lit("P"), F.lit("X")))), ",").alias("left_over"))


def g17_redacted_units(spark, sf_dir):
    """Units with at least one member that a final decision redacts."""
    final = chapter_spans(spark, sf_dir).filter("state in ('deterministic', 'confirmed_redact') and status = 'active'")
    return final.select("chapter").distinct()


def g18_snapshots(spark, sf_dir):
    """Digests of each conversation before and after a release is put together, and whether they agree."""
    turns = table(spark, sf_dir, "conversations")
    line = rec.canonical(text="text", turn="turn")
    before = rec.ordered_digest(turns, ["conv_id"], ["turn"], line)
    changed = turns.withColumn("text", F.when((F.col("conv_id") % 9 == 0) & (F.col("turn") == 1), F.concat("text", F.lit("."))).otherwise(F.col("text")))
    after = rec.ordered_digest(changed, ["conv_id"], ["turn"], line)
    return before.select("conv_id", F.col("digest").alias("a")).join(after.select("conv_id", F.col("digest").alias("b")), "conv_id").select("conv_id", (F.col("a") == F.col("b")).alias("same"))


def h7_registry(spark, sf_dir):
    """Records that may not be registered: repeated name, ill-formed id, too large."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 29 == 0, "bad id").otherwise(F.concat(F.lit("unit-"), F.col("p_partkey") - (F.col("p_partkey") % 31 == 0).cast("int"))).alias("id"), F.octet_length("p_name").alias("size"))
    twice = F.count("*").over(Window.partitionBy("id")) > 1
    code = F.when(~F.col("id").rlike("^[a-z0-9][a-z0-9-]*$"), "id").when(twice, "repeated").when(F.col("size") > 34, "size")
    return rows.select("p_partkey", code.alias("code")).filter("code is not null")


def h8_authority(spark, sf_dir):
    """Coverage rows that their units don't allow: one fault of each kind is planted by number."""
    k = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders")
    units = orders.filter(k % 97 != 1).select(k.alias("unit"), F.when(k % 6 == 0, "routine").otherwise("work").alias("kind"), F.when(k % 10 == 0, k - 1).alias("duplicate_of"))
    shown = F.col("o_orderstatus") == "O"
    reason = F.when(k % 10 == 0, "duplicate").when(k % 6 == 0, "routine_non_narrative").when(k % 4 == 1, "privacy_withheld").when(k % 89 == 3, "duplicate").when(k % 83 == 5, "because").otherwise("routine_non_narrative")
    rows = orders.filter(k % 97 != 2).select(k.alias("unit"), F.when(shown, "represented").otherwise("excluded").alias("disposition"), F.when(shown & (k % 79 != 4), F.col("o_custkey")).alias("owner"), F.when(~shown, reason).alias("reason"))
    rows = rows.unionByName(rows.filter("unit % 101 = 7"))
    return authority.coverage_faults(units, rows, g17_redacted_units(spark, sf_dir).withColumnRenamed("chapter", "unit"))


def h9_coverage_revisions(spark, sf_dir):
    """Revisions of coverage rows carried forward: orders now against orders of an earlier state."""
    orders = table(spark, sf_dir, "orders")
    row = rec.digest(rec.canonical(owner="o_custkey", status="o_orderstatus", unit="o_orderkey"))
    now = orders.filter("o_orderkey % 13 <> 0").select("o_orderkey", row.alias("digest"))
    was = orders.filter("o_orderkey % 11 <> 0").select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, F.lit("old")).otherwise(row).alias("digest"), (F.col("o_orderkey") % 3 + 1).alias("revision"))
    return relate.revisions(now, was, "o_orderkey", "digest").groupBy("change", "revision").agg(F.count("*").alias("n"))


def h10_unused_units(spark, sf_dir):
    """Represented units of which no member is cited."""
    cited = table(spark, sf_dir, "lineitem").filter("l_quantity > 30").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").join(cited, "o_orderkey", "left_anti").select("o_orderkey")


def t2_chapter_selection(spark, sf_dir):
    """Chapters told several times: the same body counts once, different ones are a conflict."""
    told = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 400).alias("key"), F.when(F.col("l_orderkey") % 400 < 200, F.col("l_orderkey") % 400).otherwise(F.col("l_partkey")).alias("body"))
    return told.groupBy("key").agg(F.countDistinct("body").alias("bodies"), F.count("*").alias("n")).select("key", (F.col("bodies") > 1).alias("conflict"), (F.col("n") - F.col("bodies")).alias("n_repeats"))


def t4_actor_coverage(spark, sf_dir):
    """Actors of cited blocks that no person stands for, and persons without a block."""
    cited = conversation_items(spark, sf_dir).filter("role <> 'system' and sequence % 3 <> 0").select("document_id", "actor_type").distinct().withColumn("cited", F.lit(True))
    people = conversation_items(spark, sf_dir).filter("role <> 'system' and sequence <= 2").select("document_id", "actor_type").distinct().withColumn("told", F.lit(True))
    both = cited.join(people, ["document_id", "actor_type"], "full_outer")
    return both.filter("cited is null or told is null").select("document_id", "actor_type", F.when(F.col("cited").isNull(), "person_without_block").otherwise("actor_without_person").alias("code"))


def t5_grounded_quotes(spark, sf_dir):
    """Quotes that do not stand in the turn they cite."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    quotes = turns.filter("length(text) > 30").select("conv_id", F.col("turn").alias("from"), F.when(F.col("turn") % 3 == 1, F.col("turn") - 1).otherwise(F.col("turn")).alias("turn"), F.substring("text", 11, 18).alias("quote"))
    return quotes.join(turns, ["conv_id", "turn"], "left").filter(~F.coalesce(F.contains("text", "quote"), F.lit(False))).select("conv_id", "from")


def t6_targets(spark, sf_dir):
    """Release targets of a chapter: title, body and owner, each with its id."""
    fields = F.array(*[F.struct(F.lit(k).alias("field"), F.col(c).cast("string").alias("value")) for k, c in (("title", "o_orderpriority"), ("status", "o_orderstatus"), ("owner", "o_custkey"))])
    found = table(spark, sf_dir, "orders").select("o_orderkey", F.explode(fields).alias("f"))
    return found.select(F.concat_ws("/", "o_orderkey", "f.field").alias("target"), "f.value")


def t7_lessons(spark, sf_dir):
    """Lessons of chapters with more than five lines, and a digest of each."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("n")).filter("size(n) > 5")
    lesson = lines.select("l_orderkey", F.explode("n").alias("lesson"))
    return lesson.select("l_orderkey", "lesson", rec.digest(rec.canonical(chapter="l_orderkey", lesson="lesson")).alias("digest"))


def t12_blockers(spark, sf_dir):
    """Chapters that are blocked, with their blockers in order."""
    found = chapter_spans(spark, sf_dir).filter("state in ('needs_confirmation', 'odd')")
    return found.groupBy("chapter").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "n", "state"))), ",").alias("blockers"))


def t13_project_map(spark, sf_dir):
    per = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"))
    packed = per.groupBy("o_custkey").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("o_orderpriority", "n"))))).alias("projects"), F.max_by("o_orderpriority", F.struct("n", "o_orderpriority")).alias("main_project"))
    return packed.select("o_custkey", "projects", "main_project")


def f3_question_faults(spark, sf_dir):
    """Questions that may not be asked, with the first fault of each; faults are planted by number."""
    k = F.col("p_partkey")
    options = F.when(k % 23 == 0, F.array(F.lit("Yes."), F.lit("yes "))).when(k % 19 == 0, F.array(F.lit("one"))).when(k % 29 == 0, F.array(F.lit("other"), F.lit("b"))).otherwise(F.array(F.col("p_brand"), F.col("p_type")))
    evidence = F.when(k % 17 == 0, F.array().cast("array<bigint>")).when(k % 13 == 0, F.array(k, k)).otherwise(F.array(k, k + 1))
    text = F.when(k % 31 == 0, " ").otherwise(F.col("p_name"))
    code = authority.question_code(text, F.col("p_size") * 3, options, evidence, k % 37 == 0, ("other", "none"))
    return table(spark, sf_dir, "part").select("p_partkey", code.alias("code")).filter("code is not null")


def f5_batch_digest(spark, sf_dir):
    """Questions and bulk decisions, type by type, as one digest for each brand: of the digests of a hundred numbers each, in order; none at all has a digest too."""
    probes = table(spark, sf_dir, "part").filter("p_size % 2 = 0").select("p_brand", F.lit("probe").alias("type"), F.col("p_partkey").alias("id"))
    bulk = table(spark, sf_dir, "part").filter("p_size % 5 = 0").select("p_brand", F.lit("bulk").alias("type"), F.col("p_partkey").alias("id"))
    rows = probes.unionByName(bulk).select("p_brand", F.concat_ws(":", "type", "id").alias("name"), F.floor(F.col("id") / 100).alias("block"))
    some = rows.groupBy("p_brand", "block").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("name")), "\n"), 256).alias("digest"))
    found = some.groupBy("p_brand").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "digest"))), lambda x: x["digest"]), "\n").alias("all"))
    brands = table(spark, sf_dir, "part").select("p_brand").distinct().join(found, "p_brand", "left")
    return brands.select("p_brand", F.sha2(F.coalesce("all", F.lit("")), 256).alias("digest"))


def f7_lifecycle(spark, sf_dir):
    """Whether a question is active, needs an update, is inactive, history or from before."""
    k = F.col("p_partkey")
    accepted, same, bound = F.col("p_size") % 3 != 0, k % 7 != 0, k % 5 != 0
    state = F.when(~bound & (k % 2 == 0), "history").when(~bound, "legacy").when(~accepted, "inactive").when(same, "active").otherwise("needs_update")
    return table(spark, sf_dir, "part").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def f8_answers(spark, sf_dir):
    """Answers as they are exported: an option that exists, other with a text, skipped ones as such, the rest as none."""
    k, size = F.col("p_partkey"), F.col("p_size")
    answer = F.when(size % 4 == 0, "skip").when((size % 4 == 1) & (k % 3 != 0), F.concat(F.lit("other:"), "p_brand")).when(size % 4 == 2, F.concat(F.lit("option-"), k % 3))
    return table(spark, sf_dir, "part").select("p_partkey", answer.alias("answer"))


def f9_regenerated(spark, sf_dir):
    """Questions asked anew: the target must be the same and the digest another."""
    part = table(spark, sf_dir, "part")
    old = part.select("p_partkey", F.col("p_brand").alias("target"), F.sha2("p_name", 256).alias("digest"))
    new = part.filter("p_partkey % 4 <> 3").select("p_partkey", F.when(F.col("p_partkey") % 11 == 0, "x").otherwise(F.col("p_brand")).alias("new_target"), F.sha2(F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(F.reverse("p_name")), 256).alias("new_digest"))
    code = F.when(F.col("new_digest").isNull(), "missing").when(F.col("target") != F.col("new_target"), "target").when(F.col("digest") == F.col("new_digest"), "unchanged").otherwise("ok")
    return old.join(new, "p_partkey", "left").groupBy(code.alias("code")).agg(F.count("*").alias("n"))


def edit_ranges(spark, sf_dir):
    """Lines as edits of a chapter's text."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("id"), F.col("l_quantity").cast("int").alias("s"), (F.col("l_quantity") + F.col("l_partkey") % 7).cast("int").alias("e"))


def e5_segments(spark, sf_dir):
    found = authority.segments(edit_ranges(spark, sf_dir), "l_orderkey")
    return found.select("l_orderkey", "start", "end", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


def e8_conflicts(spark, sf_dir):
    """Edits of one chapter that overlap an earlier one: the running greatest end tells, without pairs."""
    rows = edit_ranges(spark, sf_dir).filter("s < e")
    before = Window.partitionBy("l_orderkey").orderBy("s", "e", "id").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("reach", F.max("e").over(before)).filter("reach > s").groupBy("l_orderkey").agg(F.count("*").alias("n_conflicts"))


def x1_stages(spark, sf_dir):
    """Each run's stage from its counts, in fixed order, and its progress."""
    per = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.count_if(F.col("o_orderstatus") == "P").alias("held"))
    runs = table(spark, sf_dir, "customer").join(per, F.col("c_custkey") == F.col("o_custkey"), "left").fillna(0, ["n", "done", "held"])
    stage = F.when(F.col("n") == 0, "collecting").when(F.col("held") > 0, "blocked").when(F.col("done") < F.col("n"), "reviewing").otherwise("ready")
    return runs.select("c_custkey", stage.alias("stage"), F.when(F.col("n") > 0, F.floor(F.col("done") * 100 / F.col("n") + F.lit(0.5))).otherwise(0).cast("long").alias("percent"))


def x3_refused_events(spark, sf_dir):
    """Workflow events that come after a final one and say something else; the same may be said again."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") == "purchase", F.when(F.col("event_id") % 3 == 0, "complete")).when(F.col("event_type") == "error", F.when(F.col("event_id") % 5 == 0, "failed")).alias("final"), "event_type")
    before = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    ended = F.first("final", ignorenulls=True).over(before)
    return rows.withColumn("ended", ended).filter("ended is not null").groupBy("user_id").agg(F.count_if(~F.col("final").eqNullSafe(F.col("ended"))).alias("n_refused"), F.first("ended").alias("ended"))


def v6_dialogue(spark, sf_dir):
    """Spoken items only, with role, order and size."""
    rows = conversation_items(spark, sf_dir).filter("actor_type in ('human', 'ai') and trim(content) <> ''")
    order = F.row_number().over(Window.partitionBy("document_id").orderBy("sequence", "item_id")).cast("long")
    return rows.select("document_id", "item_id", F.when(F.col("actor_type") == "ai", "assistant").otherwise("user").alias("speaker"), order.alias("order"), F.length("content").cast("long").alias("chars"))


def v11_span_faults(spark, sf_dir):
    """Persisted span lists that overlap, in chapters."""
    w = Window.partitionBy("l_orderkey").orderBy("s", "e", "id")
    rows = edit_ranges(spark, sf_dir).filter("s < e").withColumn("last_end", F.lag("e").over(w))
    return rows.groupBy("l_orderkey").agg(F.count_if(F.col("s") < F.col("last_end")).alias("n_overlaps"), F.count("*").alias("n")).filter("n_overlaps > 0")


def v18_phases(spark, sf_dir):
    """Owners without a phase, or with more than one."""
    phases = table(spark, sf_dir, "orders").filter("o_orderkey % 2 = 0").groupBy("o_custkey").agg(F.countDistinct("o_orderpriority").alias("n"))
    owners = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"))
    return owners.join(phases, "o_custkey", "left").fillna(0).filter("n <> 1").select("o_custkey", "n")


def v19_accepted(spark, sf_dir):
    """Owners of whose checks all are true."""
    checks = [F.bool_and(c).alias(n) for n, c in (("a", F.col("o_totalprice") > 2000), ("b", F.col("o_orderstatus") != "P"), ("c", F.col("o_orderkey") % 50 != 1))]
    found = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(*checks)
    return found.filter("a and b and c").select("o_custkey")


def v23_lanes(spark, sf_dir):
    """Records of several lanes: identical ones collapse, the same id with another body is a conflict."""
    lane = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), F.when(F.col("l_partkey") % 3 == 0, F.col("l_returnflag")).otherwise("same").alias("body"))
    return lane.groupBy("id").agg(F.countDistinct("body").alias("bodies")).groupBy((F.col("bodies") > 1).alias("conflict")).agg(F.count("*").alias("n"))


def v30_chapter_gate(spark, sf_dir):
    """Targets that are applied: those of chapters all of whose targets are chosen."""
    chosen = F.bool_and(F.col("l_quantity") > 5).over(Window.partitionBy("l_orderkey"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", chosen.alias("chosen")).filter("chosen").select("l_orderkey", "l_linenumber")


def v48_roster(spark, sf_dir):
    """Names to look for: parts of at least four letters of account names, but those of systems; longest first is their rank."""
    parts = table(spark, sf_dir, "customer").select(F.explode(F.split(F.lower("c_name"), "[_.#-]")).alias("name")).union(table(spark, sf_dir, "supplier").select(F.explode(F.split(F.lower("s_name"), "[_.#-]"))))
    found = parts.filter("length(name) >= 4 and name not in ('customer', 'root', 'admin')").distinct()
    return relate.numbered(found.select("name"), [F.desc(F.length("name")), F.col("name")], "rank")


def v52_stale_ids(spark, sf_dir):
    """Ids of an earlier run that the new one does not have."""
    old = table(spark, sf_dir, "events").filter("event_id % 3 <> 0").select("event_id")
    return old.join(table(spark, sf_dir, "events").filter("event_type <> 'click'").select("event_id"), "event_id", "left_anti")


def v56_event_ids(spark, sf_dir):
    """Event ids that are empty or repeated within a trajectory."""
    ids = table(spark, sf_dir, "events").select("user_id", F.when(F.col("event_id") % 173 == 0, "").otherwise(F.concat(F.lit("e"), F.col("event_id") - (F.col("event_id") % 211 == 0).cast("int") * 150)).alias("id"))
    return ids.groupBy("user_id", "id").agg(F.count("*").alias("n")).filter("n > 1 or id = ''")


def v59_currency(spark, sf_dir):
    """Rows that differ between what was submitted and what is stored, on either side."""
    stored = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    sent = stored.withColumn("c_name", F.when(F.col("c_custkey") % 40 == 0, "changed").otherwise(F.col("c_name"))).filter("c_custkey % 70 <> 0")
    return sent.exceptAll(stored).withColumn("side", F.lit("submitted")).unionByName(stored.exceptAll(sent).withColumn("side", F.lit("stored"))).select("side", "c_custkey")


def v64_membership(spark, sf_dir):
    """Members that stand in several units."""
    units = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("members"))
    return units.select(F.explode("members").alias("member")).groupBy("member").agg(F.count("*").alias("n")).filter("n > 1")


def v79_pointer(spark, sf_dir):
    """How many targets of a chapter are reviewed, and the first that is not."""
    open_ = F.col("l_linestatus") == "O"
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_if(~open_).alias("n_reviewed"), F.min(F.when(open_, F.col("l_linenumber"))).cast("long").alias("first_open"))


def v81_detail(spark, sf_dir):
    """Each document with its items in order."""
    packed = conversation_items(spark, sf_dir).groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("sequence", "item_id"))).alias("all"))
    return packed.select("document_id", F.array_join(F.transform("all", lambda x: x["item_id"]), ",").alias("items"))


def v87_default_states(spark, sf_dir):
    """A review row for every insight: the stored one, or pending at revision 1."""
    stored = table(spark, sf_dir, "part").filter("p_size % 3 = 0").select("p_partkey", F.lit("accepted").alias("s"), (F.col("p_size") % 4 + 1).cast("long").alias("r"))
    return table(spark, sf_dir, "part").select("p_partkey").join(stored, "p_partkey", "left").select("p_partkey", F.coalesce("s", F.lit("pending")).alias("state"), F.coalesce("r", F.lit(1)).alias("revision"))


QUERIES = {f.__name__: f for f in (
    g4_active_spans, g6_decision_states, g7_release_gate, g8_worker_coverage, g16_residuals, g17_redacted_units, g18_snapshots, h7_registry, h8_authority, h9_coverage_revisions, h10_unused_units,
    t2_chapter_selection, t4_actor_coverage, t5_grounded_quotes, t6_targets, t7_lessons, t12_blockers, t13_project_map, f3_question_faults, f5_batch_digest, f7_lifecycle, f8_answers, f9_regenerated,
    e5_segments, e8_conflicts, x1_stages, x3_refused_events, v6_dialogue, v11_span_faults, v18_phases, v19_accepted, v23_lanes, v30_chapter_gate, v48_roster, v52_stale_ids, v56_event_ids, v59_currency, v64_membership, v79_pointer, v81_detail, v87_default_states,
)}

_EDITS = "edits as (select l_orderkey, l_linenumber as id, cast(l_quantity as int) as s, cast(l_quantity + l_partkey % 7 as int) as e from lineitem)"
ORACLE = {
    "g4_active_spans": f"select id, text from {dealt_values(G4_WANT, 'id', 'text')} m",
    "g6_decision_states": f"with {_SPANS} select case when state = 'needs_confirmation' and l_returnflag = 'R' then 'confirmed_redact' when state = 'needs_confirmation' and l_returnflag = 'A' then 'confirmed_keep' else 'not_actionable' end as result, count(*) as n_spans from spans join lineitem on l_orderkey = chapter and l_linenumber = n group by 1",
    "g7_release_gate": f"""with {_SPANS} select o_orderkey, case when o_orderkey % 41 = 0 then 'no_job' when o_orderkey % 47 = 0 then 'rejected' when o_orderkey % 43 = 0 then 'not_complete' when o_orderkey % 53 = 0 then 'counts' when o_orderkey % 59 = 0 then 'no_digest' when o_orderkey % 61 = 0 then 'receipt' when o_orderkey % 67 = 0 then 'changed' else review_code end as code from orders left join reviewed on chapter = o_orderkey""",
    "g8_worker_coverage": "select conv_id, case when conv_id % 13 = 1 then 'no_report' when conv_id % 11 = 0 then 'digest' else 'turns' end as code from conversations where conv_id % 13 = 1 or conv_id % 11 = 0 or conv_id % 7 = 0 group by 1",
    "g16_residuals": "select o_custkey, coalesce(string_agg(distinct o_orderstatus, ',' order by o_orderstatus) filter (o_orderstatus in ('F', 'P', 'X')), '') as left_over from orders group by 1",
    "g17_redacted_units": f"with {_SPANS} select distinct chapter from spans where state in ('deterministic', 'confirmed_redact') and not (chapter % 37 = 0 and n = 1)",
    "g18_snapshots": "select conv_id, not (conv_id % 9 = 0 and count(*) filter (turn = 1) > 0) as same from conversations group by conv_id",
    "h7_registry": "with r as (select p_partkey, case when p_partkey % 29 = 0 then 'bad id' else 'unit-' || (p_partkey - case when p_partkey % 31 = 0 then 1 else 0 end) end as id, strlen(p_name) as size from part), c as (select p_partkey, case when id = 'bad id' then 'id' when count(*) over (partition by id) > 1 then 'repeated' when size > 34 then 'size' end as code from r) select * from c where code is not null",
    "h8_authority": f"""with {_SPANS}, private as (select distinct chapter from spans where state in ('deterministic', 'confirmed_redact') and not (chapter % 37 = 0 and n = 1)), r as (select o_orderkey as unit, o_orderstatus = 'O' as shown, o_orderkey % 79 = 4 as no_owner, case when o_orderkey % 10 = 0 then 'duplicate' when o_orderkey % 6 = 0 then 'routine_non_narrative' when o_orderkey % 4 = 1 then 'privacy_withheld' when o_orderkey % 89 = 3 then 'duplicate' when o_orderkey % 83 = 5 then 'because' else 'routine_non_narrative' end as reason from orders),
      c as (select unit, case when unit % 97 = 1 then 'unknown' when unit % 97 = 2 then 'missing' when unit % 101 = 7 then 'double_owned' when shown and no_owner then 'invalid' when not shown and reason = 'because' then 'invalid' when not shown and reason = 'duplicate' and unit % 10 <> 0 then 'authority' when not shown and reason = 'routine_non_narrative' and unit % 6 <> 0 then 'authority' when not shown and reason = 'privacy_withheld' and unit not in (select chapter from private) then 'privacy_authority' end as code from r) select * from c where code is not null""",
    "h9_coverage_revisions": "with c as (select case when o_orderkey % 13 = 0 then 'removed' when o_orderkey % 11 = 0 then 'added' when o_orderkey % 4 = 0 then 'changed' else 'same' end as change, case when o_orderkey % 13 <> 0 and o_orderkey % 11 = 0 then 1 else o_orderkey % 3 + 1 + case when o_orderkey % 13 <> 0 and o_orderkey % 4 = 0 then 1 else 0 end end as revision from orders where o_orderkey % 13 <> 0 or o_orderkey % 11 <> 0) select change, revision, count(*) as n from c group by 1, 2",
    "h10_unused_units": "select o_orderkey from orders where o_orderstatus = 'O' and not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_quantity > 30)",
    "t2_chapter_selection": "with t as (select l_orderkey % 400 as key, case when l_orderkey % 400 < 200 then l_orderkey % 400 else l_partkey end as body from lineitem) select key, count(distinct body) > 1 as conflict, count(*) - count(distinct body) as n_repeats from t group by 1",
    "t4_actor_coverage": "with i as (select 'conv-' || conv_id as document_id, turn + 1 as s, case lower(role) when 'user' then 'human' when 'assistant' then 'ai' else lower(role) end as actor_type from conversations where lower(role) <> 'system'), a as (select document_id, actor_type, bool_or(s % 3 <> 0) as cited, bool_or(s <= 2) as told from i group by 1, 2) select document_id, actor_type, case when told then 'person_without_block' else 'actor_without_person' end as code from a where cited <> told",
    "t5_grounded_quotes": 'with q as (select conv_id, turn as f, case when turn % 3 = 1 then turn - 1 else turn end as t, text[11:28] as quote from conversations where length(text) > 30) select q.conv_id, q.f as "from" from q left join conversations c on c.conv_id = q.conv_id and c.turn = q.t where not coalesce(contains(c.text, q.quote), false)',
    "t6_targets": "select o_orderkey || '/' || k as target, v as value from (select o_orderkey, unnest(['title', 'status', 'owner']) as k, unnest([o_orderpriority, o_orderstatus, o_custkey::varchar]) as v from orders)",
    "t7_lessons": "select l_orderkey, l_linenumber as lesson, sha256(to_json({chapter: l_orderkey, lesson: l_linenumber})) as digest from lineitem where l_orderkey in (select l_orderkey from lineitem group by 1 having count(*) > 5)",
    "t12_blockers": f"with {_SPANS} select chapter, string_agg(n || ':' || state, ',' order by n || ':' || state) as blockers from spans where state in ('needs_confirmation', 'odd') group by 1",
    "t13_project_map": """with p as (select o_custkey, o_orderpriority as k, count(*) as n from orders group by 1, 2) select o_custkey, '{' || string_agg('"' || k || '":' || n, ',' order by k) || '}' as projects, arg_max(k, (n, k)) as main_project from p group by 1""",
    "f3_question_faults": "with c as (select p_partkey, case when p_partkey % 31 = 0 then 'text' when p_size * 3 > 100 then 'score' when p_partkey % 17 = 0 or p_partkey % 13 = 0 then 'evidence' when p_partkey % 37 = 0 then 'foreign' when p_partkey % 23 <> 0 and p_partkey % 19 = 0 then 'options' when p_partkey % 23 = 0 or p_partkey % 29 = 0 then 'alike' end as code from part) select * from c where code is not null",
    "f5_batch_digest": "with r as (select p_brand, 'probe:' || p_partkey as x, p_partkey // 100 as b from part where p_size % 2 = 0 union all select p_brand, 'bulk:' || p_partkey, p_partkey // 100 from part where p_size % 5 = 0), e as (select p_brand, b, sha256(string_agg(x, chr(10) order by x)) as x from r group by 1, 2), d as (select p_brand, string_agg(x, chr(10) order by b) as a from e group by 1) select p.p_brand, sha256(coalesce(a, '')) as digest from (select distinct p_brand from part) p left join d using (p_brand)",
    "f7_lifecycle": "select case when p_partkey % 5 = 0 then case when p_partkey % 2 = 0 then 'history' else 'legacy' end when p_size % 3 = 0 then 'inactive' when p_partkey % 7 <> 0 then 'active' else 'needs_update' end as state, count(*) as n from part group by 1",
    "f8_answers": "select p_partkey, case when p_size % 4 = 0 then 'skip' when p_size % 4 = 1 and p_partkey % 3 <> 0 then 'other:' || p_brand when p_size % 4 = 2 then 'option-' || p_partkey % 3 end as answer from part",
    "f9_regenerated": "select case when p_partkey % 4 = 3 then 'missing' when p_partkey % 11 = 0 then 'target' when p_partkey % 3 = 0 or p_name = reverse(p_name) then 'unchanged' else 'ok' end as code, count(*) as n from part group by 1",
    "e5_segments": f"""with {_EDITS}, g as (select * from edits where s < e), b as (select l_orderkey, s as p from g union select l_orderkey, e from g), c as (select l_orderkey, p as start, lead(p) over (partition by l_orderkey order by p) as fin from b)
      select c.l_orderkey, start, fin as "end", coalesce(string_agg(distinct g.id::varchar, ',' order by g.id::varchar), '') as ids from c left join g on g.l_orderkey = c.l_orderkey and g.s <= start and fin <= g.e where fin is not null group by 1, 2, 3""",
    "e8_conflicts": f"with {_EDITS}, g as (select *, max(e) over (partition by l_orderkey order by s, e, id rows between unbounded preceding and 1 preceding) as reach from edits where s < e) select l_orderkey, count(*) as n_conflicts from g where reach > s group by 1",
    "x1_stages": "with p as (select c_custkey, count(o_orderkey) as n, count(*) filter (o_orderstatus = 'F') as done, count(*) filter (o_orderstatus = 'P') as held from customer left join orders on o_custkey = c_custkey group by 1) select c_custkey, case when n = 0 then 'collecting' when held > 0 then 'blocked' when done < n then 'reviewing' else 'ready' end as stage, cast(case when n > 0 then floor(done * 100 / n + 0.5) else 0 end as bigint) as percent from p",
    "x3_refused_events": "with r as (select user_id, event_id, case when event_type = 'purchase' and event_id % 3 = 0 then 'complete' when event_type = 'error' and event_id % 5 = 0 then 'failed' end as final from events), f as (select user_id, min(event_id) as first_final, arg_min(final, event_id) as ended from r where final is not null group by 1) select r.user_id, count(*) filter (final is distinct from ended) as n_refused, any_value(ended) as ended from r join f on f.user_id = r.user_id and event_id > first_final group by 1",
    "v6_dialogue": "select 'conv-' || conv_id as document_id, 'conv-' || conv_id || ':turn-' || turn as item_id, lower(role) as speaker, row_number() over (partition by conv_id order by turn) as \"order\", length(text) as chars from conversations where lower(role) in ('user', 'assistant') and trim(text) <> ''",
    "v11_span_faults": f"with {_EDITS}, g as (select *, lag(e) over (partition by l_orderkey order by s, e, id) as last_end from edits where s < e) select l_orderkey, count(*) filter (s < last_end) as n_overlaps, count(*) as n from g group by 1 having count(*) filter (s < last_end) > 0",
    "v18_phases": "select c_custkey as o_custkey, count(distinct o_orderpriority) as n from customer left join (select * from orders where o_orderkey % 2 = 0) on o_custkey = c_custkey group by 1 having count(distinct o_orderpriority) <> 1",
    "v19_accepted": "select o_custkey from orders group by 1 having bool_and(o_totalprice > 2000 and o_orderstatus <> 'P' and o_orderkey % 50 <> 1)",
    "v23_lanes": "with p as (select l_partkey, count(distinct case when l_partkey % 3 = 0 then l_returnflag else 'same' end) as b from lineitem group by 1) select b > 1 as conflict, count(*) as n from p group by 1",
    "v30_chapter_gate": "select l_orderkey, l_linenumber from lineitem qualify bool_and(l_quantity > 5) over (partition by l_orderkey)",
    "v48_roster": "with p as (select unnest(string_split_regex(lower(c_name), '[_.#-]')) as name from customer union select unnest(string_split_regex(lower(s_name), '[_.#-]')) from supplier) select name, row_number() over (order by length(name) desc, name) as rank from p where length(name) >= 4 and name not in ('customer', 'root', 'admin')",
    "v52_stale_ids": "select event_id from events where event_id % 3 <> 0 and event_type = 'click'",
    "v56_event_ids": "with i as (select user_id, case when event_id % 173 = 0 then '' else 'e' || (event_id - case when event_id % 211 = 0 then 150 else 0 end) end as id from events) select user_id, id, count(*) as n from i group by 1, 2 having count(*) > 1 or id = ''",
    "v59_currency": "select 'submitted' as side, c_custkey from customer where c_custkey % 40 = 0 and c_custkey % 70 <> 0 union all select 'stored', c_custkey from customer where c_custkey % 40 = 0 or c_custkey % 70 = 0",
    "v64_membership": "select l_partkey as member, count(*) as n from lineitem group by 1 having count(*) > 1",
    "v79_pointer": "select l_orderkey, count(*) filter (l_linestatus <> 'O') as n_reviewed, cast(min(l_linenumber) filter (l_linestatus = 'O') as bigint) as first_open from lineitem group by 1",
    "v81_detail": "select 'conv-' || conv_id as document_id, string_agg('conv-' || conv_id || ':turn-' || turn, ',' order by turn) as items from conversations group by conv_id",
    "v87_default_states": "select p_partkey, case when p_size % 3 = 0 then 'accepted' else 'pending' end as state, cast(case when p_size % 3 = 0 then p_size % 4 + 1 else 1 end as bigint) as revision from part",
}
