"""The edit ledger of reviewed texts: recording, undoing, applying, replaying and checking edits.

A chapter has blocks of text, by language. Actions of a reviewer become transactions: patches
of a block as it stood at the chapter's revision. Applying moves the pending ones to the next
revision; nothing is ever overwritten, so every revision of every block can be made again from
the source texts and the ledger. What happens in a chapter depends on the order of its actions, so
a chapter is folded in one task; chapters are dealt out over all tasks. A chapter's ledger is
bounded by MOST; texts and actions of a chapter beyond it are refused, not cut.

Offsets are code points, start inclusive, end exclusive.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from operator import itemgetter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.groups import folded

#: The longest text and the most transactions of a chapter, and what a new claim looks like.
LONGEST, MOST = 20_000, 5_000
LOCATOR = r"https?://|[A-Za-z]:\\|/(?:[^\s/]+/){2,}"
SENTENCE_END, STANDALONE = r"[.!?。！？](?=\s|$)", 32
ACTIVE = ("pending", "needs_evidence")

TRANSACTION = (
    "chapter long, id string, block string, language string, base_revision int, operation string, before_text string, after_text string, start int, end int, after_start int, after_end int, "
    "resolution string, requires_evidence boolean, supported boolean, applied_revision int, reverts string, redo_place int, created_at long, updated_at long, revision int"
)
OUTCOME = "chapter long, seq long, result string, id string"
SNAPSHOT = "chapter long, language string, block string, revision int, text string, void boolean"


def needs_evidence(operation: Column, before: Column, after: Column, start: Column, end: Column, size: Column) -> Column:
    """Whether an edit brings a claim of its own: a number, a place, a paragraph, a sentence, or a long sentence at either end of its block."""
    has = lambda t, p: t.rlike(p)
    ends = lambda t: F.regexp_count(t, F.lit("(?U)" + SENTENCE_END))
    bare = F.regexp_replace(after, r"(?U)^\s+|\s+$", "")
    alone = ((start == 0) | (end == size)) & (F.length(bare) >= STANDALONE) & bare.rlike("[.!?。！？]$")
    number, paragraph = has(after, "[0-9]") & ~has(before, "[0-9]"), after.contains("\n") & ~before.contains("\n")
    claims = number | has(after, "(?U)" + LOCATOR) | paragraph | (ends(after) > ends(before)) | alone
    return F.when((operation == "delete") | (bare == ""), F.lit(False)).otherwise(claims)


def _needs_evidence(operation: str, before: str, after: str, start: int, end: int, size: int) -> bool:
    """The same rule inside the fold."""
    bare = after.strip()
    if operation == "delete" or not bare:
        return False
    ends = lambda t: len(re.findall(SENTENCE_END, t))
    number = bool(re.search("[0-9]", after)) and not re.search("[0-9]", before)
    alone = (start == 0 or end == size) and len(bare) >= STANDALONE and bare[-1] in ".!?。！？"
    return number or bool(re.search(LOCATOR, after)) or ("\n" in after and "\n" not in before) or ends(after) > ends(before) or alone


def operation(before: str, after: str) -> str:
    return "insert" if not before else "replace" if after else "delete"


def conflicts(a: tuple[int, int], b: tuple[int, int]) -> bool:
    """Ranges overlap; an empty one also conflicts with what it touches."""
    if a[0] == a[1] or b[0] == b[1]:
        return max(a[0], b[0]) <= min(a[1], b[1])
    return a[0] < b[1] and b[0] < a[1]


def projected(text: str, edits: list[dict]) -> tuple[str, list[tuple[dict, int, int]]] | None:
    """The text with all edits, and where each lies in it; None where two conflict or one does not meet its text."""
    pieces, at, size, placed, last = [], 0, 0, [], None
    for x in sorted(edits, key=lambda x: (x["start"], x["end"])):
        s, e = x["start"], x["end"]
        if (last and conflicts(last, (s, e))) or not at <= s <= e <= len(text) or text[s:e] != x["before_text"]:
            return None
        pieces += [text[at:s], x["after_text"]]
        begins = size + s - at
        size, at, last = begins + len(x["after_text"]), e, (s, e)
        placed.append((x, begins, size))
    return "".join([*pieces, text[at:]]), placed


def annotated(text: str, notes: list[dict]) -> str | None:
    """The text with delete, revise and add notes, from the last to the first; None where two overlap or one does not meet its text."""
    notes = sorted(notes, key=lambda x: -x["start"])
    if any(a["start"] < b["end"] for a, b in zip(notes, notes[1:], strict=False)):
        return None
    for x in notes:
        s, e, said = x["start"], x["end"], x["after_text"]
        if text[s:e] != x["before_text"] or (x["kind"] != "delete" and not said):
            return None
        if x["kind"] == "delete":
            text = re.sub(r"\s{2,}", " ", text[:s] + text[e:]).strip()
        elif x["kind"] == "revise":
            text = (text[:s] + said + text[e:]).strip()
        else:
            gap = "" if x["before_text"][-1:].isspace() else " "
            text = (text[:e] + gap + said + text[e:]).strip()
    return text


@dataclass
class Chapter:
    """A chapter's ledger while its actions are folded. ``texts`` are the blocks at ``revision``."""

    texts: dict[tuple[str, str], str]
    revision: int = 1
    confirmed: bool = False
    edits: list[dict] = field(default_factory=list)
    redo: list[str] = field(default_factory=list)

    def active(self, key: tuple[str, str]) -> list[dict]:
        return [x for x in self.edits if (x["language"], x["block"]) == key and x["base_revision"] == self.revision and x["resolution"] in ACTIVE]

    def _settle(self, key: tuple[str, str]) -> None:
        """Where the block's active edits lie in its working text."""
        found = projected(self.texts[key], self.active(key))
        for x, s, e in found[1] if found else ():
            x["after_start"], x["after_end"] = s, e

    def _judged(self, x: dict, key: tuple[str, str]) -> dict:
        x["operation"] = operation(x["before_text"], x["after_text"])
        x["requires_evidence"] = _needs_evidence(x["operation"], x["before_text"], x["after_text"], x["start"], x["end"], len(self.texts[key]))
        return x

    def _forget_redo(self, language: str) -> None:
        of = {x["id"]: x["language"] for x in self.edits}
        self.redo = [i for i in self.redo if of[i] != language]

    def edit(self, key: tuple[str, str], start: int | None, end: int | None, inserted: str | None, seq: int, supported: bool) -> tuple[str, str | None]:
        """Replace working[start:end]. An edit within an earlier one changes that one; one between edits is new; across them it is refused."""
        base = self.texts.get(key)
        if base is None or start is None or end is None or inserted is None or "\0" in inserted:
            return "invalid", None
        found = projected(base, self.active(key))
        if found is None:
            return "overlap", None
        working, placed = found
        if not 0 <= start <= end <= len(working) or len(working) - (end - start) + len(inserted) > LONGEST or len(self.edits) >= MOST:
            return "invalid", None
        if working[start:end] == inserted:
            return "unchanged", None
        touched = [p for p in placed if p[1] <= start and end <= p[2]]
        if len(touched) > 1:
            return "overlap", None
        if touched:
            x, s, _ = touched[0]
            x["after_text"] = x["after_text"][: start - s] + inserted + x["after_text"][end - s :]
            x |= {"resolution": "reverted" if x["after_text"] == x["before_text"] else "pending", "updated_at": seq, "supported": supported}
            self._judged(x, key)
        else:
            base_at = work_at = 0
            for item, s, e in [*placed, ({"start": len(base), "end": len(base)}, len(working), len(working))]:
                if work_at <= start and end <= s:
                    break
                base_at, work_at = item["end"], e
            else:
                return "overlap", None
            s = base_at + start - work_at
            x = {"id": f"{key[1]}:edit:{seq}", "block": key[1], "language": key[0], "base_revision": self.revision, "before_text": working[start:end], "after_text": inserted, "start": s, "end": s + end - start, "after_start": s, "after_end": s + len(inserted)}
            x |= {"resolution": "pending", "supported": supported, "applied_revision": None, "reverts": None, "created_at": seq, "updated_at": seq}
            if any(conflicts((p["start"], p["end"]), (x["start"], x["end"])) for p, _, _ in placed):
                return "overlap", None
            self.edits.append(self._judged(x, key))
        self._forget_redo(key[0])
        self._settle(key)
        return "recorded", x["id"]

    def undo(self, language: str) -> tuple[str, str | None]:
        """Revert the edit that was changed last."""
        mine = [(x["updated_at"], i) for i, x in enumerate(self.edits) if x["language"] == language and x["resolution"] in ACTIVE]
        if not mine:
            return "nothing", None
        x = self.edits[max(mine)[1]]
        x["resolution"] = "reverted"
        self.redo = [i for i in self.redo if i != x["id"]] + [x["id"]]
        self._settle((x["language"], x["block"]))
        return "undone", x["id"]

    def again(self, language: str) -> tuple[str, str | None]:
        """Make pending again what was undone last."""
        for i in reversed(self.redo):
            x = next(x for x in self.edits if x["id"] == i)
            if x["language"] == language and x["resolution"] == "reverted":
                x["resolution"] = "pending"
                self.redo.remove(i)
                self._settle((x["language"], x["block"]))
                return "redone", i
        return "nothing", None

    def discard(self, target: str | None) -> tuple[str, str | None]:
        x = next((x for x in self.edits if x["id"] == target and x["resolution"] in ACTIVE), None)
        if x is None:
            return "nothing", None
        x["resolution"] = "reverted"
        self.redo = [i for i in self.redo if i != target]
        self._settle((x["language"], x["block"]))
        return "discarded", target

    def revert(self, target: str | None, seq: int) -> tuple[str, str | None]:
        """A pending edit that takes an applied one back, if nothing later was applied to its block."""
        x = next((x for x in self.edits if x["id"] == target and x["resolution"] == "applied"), None)
        if x is None or len(self.edits) >= MOST:
            return "invalid", None
        key = (x["language"], x["block"])
        later = any((y["language"], y["block"]) == key and y["resolution"] == "applied" and y["applied_revision"] > x["applied_revision"] for y in self.edits)
        s, e = x["after_start"], x["after_end"]
        if later or self.texts[key][s:e] != x["after_text"] or any(conflicts((y["start"], y["end"]), (s, e)) for y in self.active(key)):
            return "overlap", None
        back = x | {"id": f"{x['block']}:revert:{seq}", "base_revision": self.revision, "operation": operation(x["after_text"], x["before_text"]), "before_text": x["after_text"], "after_text": x["before_text"], "start": s, "end": e, "after_start": s, "after_end": s + len(x["before_text"])}
        back |= {"resolution": "pending", "requires_evidence": False, "supported": False, "applied_revision": None, "reverts": target, "created_at": seq, "updated_at": seq}
        self.edits.append(back)
        self._forget_redo(x["language"])
        self._settle(key)
        return "reverting", back["id"]

    def apply(self) -> tuple[str, str | None]:
        """All pending edits become the next revision; one that lacks its evidence stops all."""
        mine = [x for x in self.edits if x["resolution"] in ACTIVE]
        bare = [x for x in mine if x["requires_evidence"] and not x["supported"]]
        for x in bare:
            x["resolution"] = "needs_evidence"
        if bare:
            return "needs_evidence", bare[0]["id"]
        if not mine:
            return "nothing", None
        keys = {(x["language"], x["block"]) for x in mine}
        found = {key: projected(self.texts[key], self.active(key)) for key in keys}
        if any(f is None for f in found.values()):
            return "overlap", None
        self.revision += 1
        for x in mine:
            x |= {"resolution": "applied", "applied_revision": self.revision}
        self.texts |= {key: f[0] for key, f in found.items()}
        return "applied", None

    def act(self, a: dict) -> tuple[str, str | None]:
        if self.confirmed:
            return "confirmed", None
        kind = a["kind"]
        if kind == "edit":
            return self.edit((a["language"], a["block"]), a["start"], a["end"], a["inserted"], a["seq"], bool(a["supported"]))
        if kind == "confirm":
            if any(x["resolution"] in ACTIVE for x in self.edits):
                return "unresolved", None
            self.confirmed = True
            return "confirmed", None
        one = {"undo": lambda: self.undo(a["language"]), "redo": lambda: self.again(a["language"]), "discard": lambda: self.discard(a["target"]), "revert": lambda: self.revert(a["target"], a["seq"]), "apply": self.apply}.get(kind)
        return one() if one else ("invalid", None)


def _texts(blocks: list[dict]) -> dict[tuple[str, str], str]:
    return {(r["language"], r["block"]): r["text"] or "" for r in blocks}


def _folded(blocks: list[dict], actions: list[dict]) -> tuple[Chapter, list[tuple]]:
    chapter = Chapter(_texts(blocks))
    return chapter, [(a, *chapter.act(a)) for a in sorted(actions, key=lambda a: a["seq"])]


def _by_chapter(blocks: DataFrame, other: DataFrame, fold: Callable[[list[dict], list[dict]], list[dict]], schema: str, columns: list[str]) -> DataFrame:
    """What ``fold`` makes of each chapter's blocks and of its rows of ``other``: chapters are walked one after another, not called one by one."""
    key, own = F.col("chapter").cast("long").alias("chapter"), ["block", "language", "text"]
    names = [c.split()[0] for c in schema.split(", ")][1:]
    rows = blocks.select(key, *own, F.lit(True).alias("is_block")).unionByName(other.select(key, *columns, F.lit(False).alias("is_block")), allowMissingColumns=True)
    has = rows.columns[1:]

    def run(chapter: int, held: list[tuple]) -> Iterator[tuple]:
        left, right = [], []
        for r in held:
            x = dict(zip(has, r[1:], strict=True))
            (left if x["is_block"] else right).append(x)
        made = itemgetter(*names)
        return ((chapter, *made(x)) for x in fold(left, right))

    return folded(rows, "chapter", run, schema)


ACTION = ["seq", "kind", "block", "language", "start", "end", "inserted", "target", "supported"]


def transactions(blocks: DataFrame, actions: DataFrame) -> DataFrame:
    """The ledger that ``actions`` leave: one row per transaction.

    blocks: chapter, block, language, text. actions: chapter, seq (their order), kind (edit, undo,
    redo, discard, revert, apply, confirm), and what the kind needs of block, language, start, end,
    inserted, target, supported. Rows without chapter belong to none; null texts are empty.
    """

    def fold(left: list[dict], right: list[dict]) -> list[dict]:
        chapter, _ = _folded(left, right)
        place = {i: k for k, i in enumerate(chapter.redo)}
        return [x | {"redo_place": place.get(x["id"]), "revision": chapter.revision} for x in chapter.edits]

    return _by_chapter(blocks, actions, fold, TRANSACTION, ACTION)


def outcomes(blocks: DataFrame, actions: DataFrame) -> DataFrame:
    """What came of each action: recorded, unchanged, undone, redone, nothing, discarded, reverting, applied, or why not."""

    def fold(left: list[dict], right: list[dict]) -> list[dict]:
        return [{"seq": a["seq"], "result": result, "id": i} for a, result, i in _folded(left, right)[1]]

    return _by_chapter(blocks, actions, fold, OUTCOME, ACTION)


CHANGE = ["id", "block", "language", "kind", "start", "end", "before_text", "after_text", "base_revision", "applied_revision"]


def snapshots(blocks: DataFrame, changes: DataFrame) -> DataFrame:
    """Every revision of every block: (chapter, language, block, revision, text, void).

    changes: the applied ones, kind edit for transactions and delete, revise or add for notes. A
    revision is made from the one before it by the edits or the notes of each block. Where one does
    not meet its text, two conflict, edits and notes of a block meet in one revision, the block is
    not there, or the base is another than the revision before, the chapter is void: it keeps its
    first revision alone.
    """

    def fold(left: list[dict], right: list[dict]) -> list[dict]:
        now = _texts(left)
        rows = [(*k, 1, t) for k, t in now.items()]
        by: dict[int, dict[tuple, list[dict]]] = {}
        for x in right:
            by.setdefault(x["applied_revision"], {}).setdefault((x["language"], x["block"]), []).append(x)
        void = any(r is None or r < 2 for r in by)
        for r in range(2, max((r for r in by if r), default=1) + 1):
            for k, group in by.get(r, {}).items():
                edits = [x for x in group if x["kind"] == "edit"]
                made = None
                if k in now and len(edits) in (0, len(group)) and all(x["base_revision"] == r - 1 for x in group):
                    made = (projected(now[k], edits) or (None,))[0] if edits else annotated(now[k], group)
                void |= made is None
                now[k] = made
            if void:
                break
            rows += [(*k, r, t) for k, t in now.items()]
        return [{"language": la, "block": b, "revision": r, "text": t, "void": void} for la, b, r, t in rows if not void or r == 1]

    return _by_chapter(blocks, changes, fold, SNAPSHOT, CHANGE)


def replayed(blocks: DataFrame, changes: DataFrame) -> DataFrame:
    """Each block's text after all revisions: (chapter, language, block, text). A block whose own changes do not fit keeps its source; others are not touched by that."""

    def fold(left: list[dict], right: list[dict]) -> list[dict]:
        mine: dict[tuple, dict[int, list[dict]]] = {}
        for x in right:
            if x["applied_revision"] is not None and x["applied_revision"] >= 2:
                mine.setdefault((x["language"], x["block"]), {}).setdefault(x["applied_revision"], []).append(x)
        rows = []
        for (language, block), source in _texts(left).items():
            text = source
            for _, group in sorted(mine.get((language, block), {}).items()):
                edits = [x for x in group if x["kind"] == "edit"]
                made = None if len(edits) not in (0, len(group)) else (projected(text, edits) or (None,))[0] if edits else annotated(text, group)
                if made is None:
                    text = source
                    break
                text = made
            rows.append({"language": language, "block": block, "text": text})
        return rows

    return _by_chapter(blocks, changes, fold, "chapter long, language string, block string, text string", CHANGE)


def faults(ledger: DataFrame, blocks: DataFrame, history: DataFrame) -> DataFrame:
    """What is wrong with each chapter's ledger: distinct (chapter, code).

    ledger as ``transactions`` gives it; history: chapter, revision, ids (of what that revision applied).
    """
    active, applied = F.col("resolution").isin(*ACTIVE), F.col("resolution") == "applied"
    shots = snapshots(blocks, ledger.filter(applied).withColumn("kind", F.lit("edit")))
    # a void chapter has first revisions alone: one row tells each of its transactions so
    at = shots.select("chapter", "language", "block", F.col("revision").alias("of"), "text", "void")
    same = [ledger[c].eqNullSafe(at[c]) for c in ("chapter", "language", "block")]
    t = ledger.join(at, (functools.reduce(Column.__and__, same)) & (at["void"] | (ledger["base_revision"] == at["of"])), "left").select(ledger["*"], at["void"], F.when(~at["void"], at["text"]).alias("text"))
    # a chapter's windows hold its ledger, which is bounded
    of_id, of_chapter = Window.partitionBy("chapter", "id"), Window.partitionBy("chapter")
    # the chapter's comes first: the others are dealt out by it too
    t = t.withColumn("is_void", F.max(F.coalesce("void", F.lit(False))).over(of_chapter)).withColumn("n_id", F.count("*").over(of_id)).withColumn("active", active)
    # the least of what came before tells of any conflict, without pairs
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    order = before(Window.partitionBy("chapter", "language", "block", "active").orderBy("start", "end", "id"))
    empty = F.col("start") == F.col("end")
    ends, inserts = F.max("end").over(order), F.max(F.when(empty, F.col("end"))).over(order)
    t = t.withColumn("meets", active & ((ends > F.col("start")) | (empty & (ends >= F.col("start"))) | (inserts >= F.col("start"))))
    group = before(Window.partitionBy("chapter", "language", "block", "applied_revision", "active").orderBy("start", "end"))
    moved = F.coalesce(F.sum(F.length("after_text") - (F.col("end") - F.col("start"))).over(group), F.lit(0)) + F.col("start")
    t = t.withColumn("at", moved)
    kind = F.when(F.col("before_text") == "", "insert").when(F.col("after_text") == "", "delete").otherwise("replace")
    codes = {
        "duplicate_id": F.col("n_id") > 1,
        "redo_not_reverted": F.col("redo_place").isNotNull() & (F.col("resolution") != "reverted"),
        "shape": (F.col("end") < F.col("start")) | (F.length("before_text") != F.col("end") - F.col("start")) | (F.length("after_text") > LONGEST),
        "operation": (kind != F.col("operation")) | ((F.col("before_text") == F.col("after_text")) & (F.col("resolution") != "reverted")),
        "resolution": applied != F.col("applied_revision").isNotNull(),
        "applied_base": applied & ((F.col("base_revision") != F.col("applied_revision") - 1) | (F.col("applied_revision") > F.col("revision"))),
        "active_base": active & (F.col("base_revision") != F.col("revision")),
        "evidence_state": (F.col("resolution") == "needs_evidence") & ~F.col("requires_evidence"),
        "clock": F.col("updated_at") < F.col("created_at"),
        "active_conflict": F.col("meets"),
        "void": F.col("is_void"),
        "before_text": ~F.col("is_void") & (F.col("text").isNull() | (F.substr("text", F.col("start") + 1, F.col("end") - F.col("start")) != F.col("before_text"))),
        "after_range": applied & ((F.col("after_start") != F.col("at")) | (F.col("after_end") != F.col("at") + F.length("after_text"))),
    }
    own = t.select("chapter", F.explode(F.array_compact(F.array(*[F.when(when, code) for code, when in codes.items()]))).alias("code"))
    # what the history says of each revision, against what the ledger says
    said = history.select("chapter", "revision", F.explode("ids").alias("id"), F.lit(1).alias("said"), F.lit(0).alias("held"))
    held = ledger.filter(applied).select("chapter", F.col("applied_revision").alias("revision"), "id", F.lit(0).alias("said"), F.lit(1).alias("held"))
    both = said.unionByName(held).groupBy("chapter", "id").agg(F.sum("said").alias("said"), F.collect_set(F.when(F.col("said") == 1, F.col("revision"))).alias("in_history"), F.collect_set(F.when(F.col("held") == 1, F.col("revision"))).alias("in_ledger"))
    codes = {"history_repeats": F.col("said") > 1, "history_unknown": F.size(F.array_except("in_history", "in_ledger")) > 0, "history_missing": F.size(F.array_except("in_ledger", "in_history")) > 0}
    listed = both.select("chapter", F.explode(F.array_compact(F.array(*[F.when(when, code) for code, when in codes.items()]))).alias("code"))
    last = ledger.groupBy("chapter").agg(F.max("revision").alias("last"))
    rows = history.groupBy("chapter").agg(F.count("*").alias("n"), F.min("revision").alias("low"), F.max("revision").alias("high"), F.count_distinct("revision").alias("n_distinct"))
    n = F.coalesce("n", F.lit(0))
    gaps = last.join(rows, "chapter", "left").filter((n != F.col("last") - 1) | ((n > 0) & ((F.col("low") != 2) | (F.col("high") != F.col("last")) | (F.col("n_distinct") != n))))
    return own.unionByName(listed).unionByName(gaps.select("chapter", F.lit("history_gap").alias("code"))).distinct()
