import copy
import json

import pytest
from pyspark.sql import functions as F

from quarry.functions import shape as S
from quarry.operators import stories

REF = {"documentId": "d", "eventId": "e"}
GOOD = {
    "schema": "story", "key": "k", "language": "zh", "languagePolicyDigest": "a" * 64, "phase": {"id": "p", "label": "Start"}, "title": "T", "overview": "O", "kind": "decision", "transition": {"before": "b", "after": "a"}, "chips": ["x", "y"],
    "people": [{"id": "p", "releaseLabel": "P", "role": "r", "description": "d", "localIdentityState": "local_only", "evidence": [REF]}], "story": {"blocks": [{"id": "b", "text": "t", "evidence": [REF | {"label": ""}]}], "uncertainty": "u"},
    "insights": [{"id": "i", "title": "", "background": "b", "anchorStoryBlockId": "b", "quote": {"text": "t", "evidence": REF}, "directlyAcquiredExperience": "x", "principle": "y", "evidence": []}], "evidence": {"primary": REF, "supporting": [REF | {"eventId": "f"}]},
    "coverage": {"semanticManifest": {"revision": 1, "digest": "0" * 64}, "coverageManifest": {"revision": 2.0, "digest": "f" * 64}, "representedUnitIds": ["u"], "excludedUnits": [{"unitId": "v", "reason": "duplicate"}]},
}


def at(value, path, new):
    value = copy.deepcopy(value)
    of = value
    for k in path[:-1]:
        of = of[k]
    if new is None:
        del of[path[-1]]
    else:
        of[path[-1]] = new
    return value


CASES = [
    (("title",), None, "$.title", "missing"), (("title",), " ", "$.title", "blank"), (("title",), 5, "$.title", "not_text"), (("title",), "x" * 501, "$.title", "too_long"), (("odd",), 1, "$.odd", "unknown_field"), (("kind",), "odd", "$.kind", "not_allowed"), (("languagePolicyDigest",), "A" * 64, "$.languagePolicyDigest", "form"),
    (("phase",), [], "$.phase", "not_object"), (("chips",), {}, "$.chips", "not_list"), (("chips",), ["x"] * 2, "$.chips", "repeated"), (("chips",), [str(k) for k in range(13)], "$.chips", "length"), (("story", "blocks"), [], "$.story.blocks", "length"), (("people", 0, "evidence"), [REF, REF | {"label": "l"}], "$.people[0].evidence", "repeated"),
    (("insights", 0, "quote", "evidence", "label"), "x", "$.insights[0].quote.evidence.label", "unknown_field"), (("evidence", "supporting"), [REF], "$.evidence.supporting", "repeated"), (("coverage", "semanticManifest", "revision"), 1.5, "$.coverage.semanticManifest.revision", "not_whole"), (("coverage", "semanticManifest", "revision"), True, "$.coverage.semanticManifest.revision", "not_whole"),
    (("coverage", "semanticManifest", "revision"), 2**53, "$.coverage.semanticManifest.revision", "out_of_range"), (("coverage", "representedUnitIds"), ["v"], "$.coverage.excludedUnits", "represented_too"), (("coverage", "representedUnitIds"), [f"n{k}" for k in range(512)], "$.coverage", "too_many_units"),
]


@pytest.mark.parametrize(("path", "new", "where", "code"), CASES)
def test_one_fault_of_each_kind(path, new, where, code):
    assert S.faults_of("story:" + json.dumps(at(GOOD, path, new)), stories.story_shape(), "story:") == [{"path": where, "code": code}]


def test_texts(spark):
    good = "story:" + json.dumps(GOOD)
    rows = [(1, good), (2, None), (3, good[1:]), (4, good[:-1]), (5, good[:-1] + ',"key":"k"}'), (6, "story:[]"), (7, "story:" + "[" * 50_000), (8, "story:" + json.dumps(GOOD | {"coverage": 1, "title": ""}))]
    found = stories.story_faults(spark.createDataFrame(rows, "i int, t string").coalesce(1), "t")
    got = {x["i"]: None if x["faults"] is None else [tuple(f) for f in x["faults"]] for x in found.collect()}
    assert got == {1: [], 2: None, 3: [("$", "prefix")], 4: [("$", "not_json")], 5: [("$", "duplicate_key")], 6: [("$", "not_object")], 7: [("$", "too_deep")], 8: [("$.title", "blank"), ("$.coverage", "not_object")]}
    assert found.filter(F.size("faults") == 0).count() == 1
