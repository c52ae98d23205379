"""Stories as nested values: their shape, and which of them have it."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import shape as S

#: Kinds of chapters, why a unit is left out, and bounds.
KINDS = ("foundation", "discovery", "baseline", "problem", "failure", "root_cause", "decision", "direction_change", "breakthrough", "quantitative_change", "validation", "freeze", "handoff", "current_state")
EXCLUSIONS = ("duplicate", "privacy_withheld", "routine_non_narrative", "outside_story_scope")
IDENTITY = ("not_identified", "local_only")
MOST_UNITS = 512


def _reference(x: dict) -> str:
    return json.dumps([x["documentId"], x["eventId"]])


def _one_place(x: dict) -> Iterator[S.Fault]:
    """A unit is represented or excluded, not both, and there are not too many of both."""
    kept, out = x["representedUnitIds"], [u["unitId"] for u in x["excludedUnits"]]
    if len(kept) + len(out) > MOST_UNITS:
        yield "", "too_many_units"
    if set(kept) & set(out):
        yield ".excludedUnits", "represented_too"


def _references_differ(x: dict) -> Iterator[S.Fault]:
    every = [_reference(r) for r in (x["primary"], *x["supporting"])]
    if len(set(every)) < len(every):
        yield ".supporting", "repeated"


def story_shape(schema: str = "story") -> S.Fields:
    """What a story is: its chapter, people, blocks, insights, evidence and coverage."""
    name, digest = S.Text(1_000), S.Text(pattern="[0-9a-f]{64}")
    evidence = S.Fields({"documentId": name, "eventId": name}, {"label": S.Text(500, blank=True)})
    some = S.Each(evidence, least=1, key=_reference)
    by_id = lambda x: x["id"]
    person = S.Fields({"id": name, "releaseLabel": S.Text(), "role": S.Text(), "description": S.Text(), "localIdentityState": S.Text(among=IDENTITY), "evidence": some})
    block = S.Fields({"id": name, "text": S.Text(20_000), "evidence": some})
    quote = S.Fields({"text": S.Text(20_000), "evidence": S.Fields({"documentId": name, "eventId": name})})
    insight = S.Fields({"id": name, "background": S.Text(4_000), "anchorStoryBlockId": name, "quote": quote, "directlyAcquiredExperience": S.Text(4_000), "principle": S.Text(4_000), "evidence": S.Each(evidence, key=_reference)}, {"title": S.Text(500, blank=True)})
    manifest = S.Fields({"revision": S.Whole(1), "digest": digest})
    unit = S.Fields({"unitId": name, "reason": S.Text(among=EXCLUSIONS)})
    coverage = S.Fields({"semanticManifest": manifest, "coverageManifest": manifest, "representedUnitIds": S.Each(name, key=str), "excludedUnits": S.Each(unit, key=lambda x: x["unitId"])}, also=(_one_place,))
    return S.Fields(
        {
            "schema": S.Text(among=(schema,)), "key": name, "language": S.Text(among=("en", "zh")), "languagePolicyDigest": digest, "phase": S.Fields({"id": name, "label": S.Text()}), "title": S.Text(500), "overview": S.Text(20_000),
            "people": S.Each(person, key=by_id), "story": S.Fields({"blocks": S.Each(block, least=1, key=by_id)}, {"uncertainty": S.Text(4_000)}), "insights": S.Each(insight, key=by_id),
            "evidence": S.Fields({"primary": evidence, "supporting": S.Each(evidence)}, also=(_references_differ,)), "coverage": coverage,
        },
        {"kind": S.Text(among=KINDS), "transition": S.Fields({"before": S.Text(500), "after": S.Text(500)}), "chips": S.Each(S.Text(200), most=12, key=str)},
    )


def story_faults(stories: DataFrame, text: Column | str, schema: str = "story", prefix: str = "story:") -> DataFrame:
    """The rows with ``faults``, an array of (path, code): a row is a story where it is empty. Null texts have null faults."""
    column = F.col(text) if isinstance(text, str) else text
    return stories.withColumn("faults", S.faults(column, story_shape(schema), prefix))
