"""Packages of stories by hand: what the whole-table query does not plant."""

import copy
import json

from pyspark.sql import functions as F

from quarry.operators import packages
from tests.test_stories import GOOD

CHAPTER = "package string, place int, id string, document_id string, summary string, code string"
EVIDENCE = "package string, document_id string, event_id string, actor_type string, event_type string, actor_id string, narrative string, code string"
UNITS = "package string, unit_id string, member string"
COVERAGE = "package string, unit_id string, disposition string, owner_id string, reason string"
MANIFESTS = "package string, semantic_revision long, semantic_digest string, coverage_revision long, coverage_digest string, covers_revision long, covers_digest string"


def story(**changes):
    s = copy.deepcopy(GOOD) | {"language": "en"}
    for path, value in changes.items():
        at = s
        *way, last = path.split("__")
        for k in way:
            at = at[int(k)] if k.isdigit() else at[k]
        at[last] = value
    return "story:" + json.dumps(s)


def codes(spark, chapters, evidence, units=(), coverage=(), manifests=()):
    tables = [(chapters, CHAPTER), (evidence, EVIDENCE), (units, UNITS), (coverage, COVERAGE), (manifests, MANIFESTS)]
    found = packages.package_codes(*[spark.createDataFrame(list(rows), schema) for rows, schema in tables])
    return {r["package"]: (r["code"], r["place"]) for r in found.collect()}


def item(package, event="e", document="d", kind="human", event_type="message", who="me", text="it says t here"):
    return (package, document, event, kind, event_type, who, text, "")


def test_without_a_manifest(spark):
    """Chapters against their evidence alone; null summaries, evidence by tools, repeated ids, labels of three words."""
    plain = {
        "good": [story()], "null": [None], "tool": [story()], "elsewhere": [story()], "words": [story(phase__label="One two three")], "trimmed": [story(phase__label=" Start\t")],
        "generic": [story(phase__label="OTHER")], "relabelled": [story(), story(key="k2", phase__label="Else", coverage__representedUnitIds=["w"], coverage__excludedUnits=[])],
        "twice": [story(), story(key="k2")], "stranger": [story(people__0__evidence=[{"documentId": "d", "eventId": "f"}])], "unanchored": [story(insights__0__anchorStoryBlockId="zz")], "two": [story(people=[GOOD["people"][0], GOOD["people"][0] | {"id": "q"}])],
    }
    chapters = [(name, i, "e", "d", s, "") for name, texts in plain.items() for i, s in enumerate(texts)]
    evidence = [item(name, e) for name in plain for e in ("e", "f") if name not in ("tool", "elsewhere", "stranger")]
    evidence += [item("tool", kind=" TOOL "), item("tool", "f"), item("elsewhere", document="a"), item("elsewhere"), item("elsewhere", "f"), item("stranger"), item("stranger", "f", who="other"), item("alone")]
    want = dict.fromkeys(("good", "trimmed"), (None, None))
    want |= {"null": ("STORY_CHAPTER_INVALID", 0), "elsewhere": ("STORY_EVIDENCE_INVALID", 0), "alone": ("STORY_CANDIDATE_MISSING", None), "unanchored": ("STORY_INSIGHT_GROUNDING_INVALID", 0)}
    want |= dict.fromkeys(("tool", "stranger", "two"), ("STORY_PEOPLE_INVALID", 0))
    want |= dict.fromkeys(("words", "generic"), ("STORY_PHASE_INVALID", 0)) | {"relabelled": ("STORY_PHASE_INVALID", 1), "twice": ("STORY_COVERAGE_INVALID", 1)}
    assert codes(spark, chapters, evidence) == want


def test_authority(spark):
    """A unit without a row, a unit nobody declares, one that is excluded for another reason; empty tables."""
    names = ("good", "rowless", "undeclared", "reason")
    chapters, evidence = [(n, 0, "e", "d", story(), "") for n in names], [item(n, e) for n in names for e in ("e", "f")]
    units = [(n, u, m) for n in names for u, m in (("u", "e"), ("v", "g"))] + [("undeclared", "w", "h"), ("rowless", "w", "h")]
    coverage = [(n, "u", "represented", "k", None) for n in names] + [(n, "v", "excluded", None, "privacy_withheld" if n == "reason" else "duplicate") for n in names]
    coverage += [("undeclared", "w", "excluded", None, "duplicate"), ("rowless", "y", "excluded", None, "duplicate")]
    manifests = [(n, 1, "0" * 64, 2, "f" * 64, 1, "0" * 64) for n in names]
    want = {"good": (None, None), "rowless": ("STORY_COVERAGE_INVALID", None), "undeclared": ("STORY_COVERAGE_INVALID", None), "reason": ("STORY_COVERAGE_INVALID", 0)}
    assert codes(spark, chapters, evidence, units, coverage, manifests) == want
    assert codes(spark, [], []) == {}


def test_actors(spark):
    rows = [("human", "message", "a"), ("system", "message", "a"), (None, "tool_call", "a"), (None, "user_action", "a"), (None, "toolbox", "a"), ("ai", None, " "), ("ai", None, None)]
    df = spark.createDataFrame(rows, "t string, e string, i string")
    assert [r[0] for r in df.select(packages.actor(F.col("t"), F.col("e"), F.col("i"))).collect()] == ["a", "", "", "", "a", "", ""]
