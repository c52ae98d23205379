import hashlib
import json

from pyspark.sql import functions as F

from quarry.functions import canonical
from quarry.operators import receipts


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def strict(spark, texts):
    return [x[0] for x in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(canonical.strict_json(F.col("t"))).collect()]


def test_normal_form_by_hand(spark):
    """Digests of the form written out, and equal ones for equal values."""
    forms = {
        "null": '["null"]', "true": '["boolean",true]', "1": '["number","i:1"]', "1.5": '["number","f:3ff8000000000000"]', '"é"': '["string","é"]', "[]": '["array",[]]',
        '{"b":[1,null],"a":{}}': '["object",[["a",["object",[]]],["b",["array",[["number","i:1"],["null"]]]]]]', "-0.0": '["number","i:0"]', "9007199254740991": '["number","i:9007199254740991"]',
    }
    assert [x["normal_digest"] for x in strict(spark, forms)] == [sha(f) for f in forms.values()]
    same = strict(spark, ["1", "1.0", "1e0", " 1 "])
    assert len({x["normal_digest"] for x in same}) == 1 and len({x["digest"] for x in same}) == 2
    # keys by their bytes, not by UTF-16 units
    assert strict(spark, ['{"\U00010000":1,"￿":2}'])[0]["canonical"] == '{"￿":2,"\U00010000":1}'


def test_refused(spark):
    texts = ['{"a":1,"a":1}', '[{"x":{"y":1,"y":2}}]', "NaN", "[-Infinity]", "1e999", "9007199254740992", "1e300", "{", "", "1 2", "[" * 100_000, None]
    codes = ["duplicate_key", "duplicate_key", "non_finite", "non_finite", "non_finite", "unsafe_integer", "unsafe_integer", "not_json", "not_json", "not_json", "too_deep", None]
    found = strict(spark, texts)
    assert [x["code"] for x in found] == codes and all(x["digest"] is None for x in found)


def test_content_ignores_how_it_was_extracted(spark):
    event = {"event_id": "e", "event_type": "artifact", "payload": {"kind": "image", "path": "artifacts/1.png", "sha256": "x"}, "source": {"system": "s", "line": 4, "record_id": "line-4"}, "extra": 1}
    moved = event | {"payload": event["payload"] | {"path": "artifacts/2.png"}, "source": event["source"] | {"line": 9, "record_id": "line-9:2"}, "extra": 2}
    other, kept = event | {"payload": {"kind": "image", "sha256": "y"}}, event | {"source": {"system": "s", "record_id": "r-1"}}
    a, b, c, d, part = (x["content_digest"] for x in strict(spark, [json.dumps(x) for x in (event, moved, other, kept, {"payload": 1})]))
    assert a == b and len({a, c, d}) == 3
    assert part == sha('["object",[["payload",["number","i:1"]]]]')


TURN = "document_id string, document_kind string, event_id string, item_id string, sequence long, role string, timestamp string, text string"


def turns(spark, rows):
    return spark.createDataFrame([(d, "trajectory", i, i, s, "user", None, t) for d, i, s, t in rows], TURN)


def test_tree_of_a_long_document(spark):
    """No group larger than the fan; the top by hand."""
    rows = [("d", f"i{k}", k, f"text {k}") for k in range(1, 40)]
    known = receipts.turn_authorities(turns(spark, rows))
    leaves = {x["sequence"]: x["leaf"] for x in known.collect()}
    level = dict(leaves)
    tree = {(x["level"], x["node"]): x["digest"] for x in receipts.document_tree(known, 3).collect()}
    k = 0
    while True:
        assert {n: x for (lv, n), x in tree.items() if lv == k} == level
        if k and set(level) == {0}:
            break
        k += 1
        level = {u: sha("\n".join(level[n] for n in sorted(level) if n // 3 == u)) for u in {n // 3 for n in level}}
    assert max(lv for lv, _ in tree) == k


def test_changes_by_descent(spark):
    rows = [(d, f"{d}{k}", k, f"text {k}") for d in ("a", "b", "c", "e") for k in range(1, 30)]
    old, new = turns(spark, rows), [r for r in rows if r[:3] != ("a", "a7", 7) and r[0] != "e"]
    new = [(*r[:3], r[3] + "!") if r[1] == "b20" else r for r in new] + [("c", "c900", 900, "late"), ("f", "f1", 1, "new")]
    found = {tuple(x) for x in receipts.changed_turns(old, turns(spark, new), 3).collect()}
    assert found == {("a", 7, "removed"), ("b", 20, "changed"), ("c", 900, "added"), ("f", 1, "added")} | {("e", k, "removed") for k in range(1, 30)}
    assert receipts.changed_turns(old, old, 3).collect() == []


def test_each_fault(spark):
    rows = [("a", "trajectory", "x", "x", 1, None, None, "t"), ("b", "trajectory", "", "", 1, None, None, "t"), ("c", "trajectory", "p", "q", 1, None, None, "t"), ("d", "trajectory", "r", "r", 0, None, None, "t")]
    rows += [("e", "trajectory", "s", "s", 1, None, None, " "), ("f", "note", "u", "u", 1, None, None, "t"), ("g", "meeting", "v", "v", 1, None, None, "t"), ("g", "meeting", "v", "v", 2, None, None, "t"), ("h", "meeting", "w", "w", 1, None, None, "t"), ("i", "meeting", "w", "w", 1, None, None, None)]
    got = {x["document_id"]: x["code"] for x in receipts.receipts(spark.createDataFrame(rows, TURN)).collect()}
    assert got == {"a": None, "b": "identity_missing", "c": "identity_not_canonical", "d": "sequence_invalid", "e": "text_missing", "f": "kind_invalid", "g": "item_repeated", "h": "item_shared", "i": "text_missing"}
    assert receipts.receipts(spark.createDataFrame([], TURN)).collect() == []
