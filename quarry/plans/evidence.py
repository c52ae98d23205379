"""Queries over raw records: session logs, exports, meeting texts, identities and digests.

Log lines and exports are built from whole tables as text and read back by the operators; the
SQL says the same of the tables. Forms that no table holds are literal rows on both sides.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions import records as rec
from quarry.functions import text as txt
from quarry.sources.items import conversation_items, table


def literal(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def values(rows, *names):
    say = lambda v: "null" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"(values {', '.join('(' + ', '.join(map(say, r)) + ')' for r in rows)}) as t({', '.join(names)})"


def dealt(spark, sf_dir, rows, schema):
    """Every event in one of the forms, by its number: the form's rows, the first column the event's id instead of the form's, which is kept as form."""
    forms = literal(spark, rows, schema)
    first, ids = forms.columns[0], sorted({r[0] for r in rows})
    events = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % len(ids) + ids[0]).alias("form"))
    # a fixed few rows
    named = F.broadcast(forms.withColumnRenamed(first, "of_form"))
    return events.join(named, F.col("form") == F.col("of_form")).drop("of_form").withColumnRenamed("event_id", first)


def dealt_values(rows, *names):
    ids = sorted({r[0] for r in rows})
    return f"(select e.event_id as {names[0]}, t.{names[0]} as form, {', '.join(f't.{n}' for n in names[1:])} from events e join {values(rows, *names)} on t.{names[0]} = e.event_id % {len(ids)} + {ids[0]})"


def log_lines(spark, sf_dir):
    """Conversations as session logs: one JSON object a line; every seventh line is not an object, every eleventh blank."""
    turn = F.struct(F.lit("event").alias("schema"), F.concat_ws("-", F.lit("e"), "conv_id", "turn").alias("event_id"), F.lower("role").alias("type"), F.struct(F.col("text"), F.concat(F.lit("/work/p"), F.col("conv_id") % 3).alias("cwd")).alias("payload"))
    n = F.col("conv_id") * 8 + F.col("turn")
    raw = F.when(n % 11 == 5, "").when(n % 7 == 3, "[1]").otherwise(F.to_json(turn))
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file"), (F.col("turn") + 1).alias("line"), raw.alias("raw"))


_N = "(conv_id * 8 + turn)"
_GOOD = f"{_N} % 11 <> 5 and {_N} % 7 <> 3"
EVENT = "schema string, event_id string, type string, payload struct<text:string,cwd:string>"


def read_events(lines):
    """Lines that are objects of the expected schema, parsed; blank ones are skipped."""
    return lines.filter(F.trim("raw") != "").withColumn("e", F.from_json("raw", EVENT)).filter(F.trim("raw").startswith("{") & (F.col("e.schema") == "event"))


def s1_jsonl_scan(spark, sf_dir):
    return read_events(log_lines(spark, sf_dir)).select("file", "line", "e.event_id", "e.type", F.length("e.payload.text").cast("long").alias("n_chars"))


def s1_refused_lines(spark, sf_dir):
    """Lines of each file that are filled and no event."""
    filled = log_lines(spark, sf_dir).filter(F.trim("raw") != "").withColumn("e", F.from_json("raw", EVENT))
    good = F.coalesce(F.trim("raw").startswith("{") & (F.col("e.schema") == "event"), F.lit(False))
    return filled.filter(~good).groupBy("file").agg(F.count("*").alias("n_refused"))


def s3_bounded_scan(spark, sf_dir, most_lines=4, most_bytes=3000):
    """Lines of each file up to a number and a size, and whether that stopped the scan."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file"), (F.col("turn") + 1).alias("line"), F.octet_length("text").alias("size"))
    so_far = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turns = turns.withColumns({"nth": F.row_number().over(so_far), "bytes": F.sum("size").over(so_far)})
    read = (F.col("nth") <= most_lines) & (F.col("bytes") <= most_bytes)
    return turns.groupBy("file").agg(F.count_if(read).alias("n_read"), F.max(F.when(read, F.col("bytes"))).alias("n_bytes"), F.bool_or(~read).alias("stopped"))


META = [(1, 1, '{"type":"session_meta","payload":{"cwd":"/a","id":"s1"}}'), (1, 2, '{"type":"message","payload":{"cwd":"/hidden"}}'), (1, 3, '{"type":"turn_context","payload":{"cwd":"/b"}}'), (2, 1, '{"type":"message","cwd":"/top"}'), (2, 2, '{"type":"message","payload":{"text":"cwd /x"}}'), (3, 1, '{"type":"turn_context","payload":{"cwd":7}}')]


def s4_structured_cwd(spark, sf_dir):
    """The working folder from the fields meant for it, never from a message's body."""
    rows = dealt(spark, sf_dir, META, "file int, line int, raw string")
    kind, inner, top = (F.get_json_object("raw", p) for p in ("$.type", "$.payload.cwd", "$.cwd"))
    return rows.select("file", "line", F.coalesce(F.when(kind.isin("session_meta", "turn_context"), inner), top).alias("cwd"))


PATHS = [(1, "/work/repo"), (2, "/work/repo/sub/./x/.."), (3, "/work"), (4, "/work/other"), (5, "/home/x"), (6, "relative"), (7, "C:\\Work\\Repo"), (8, "/mnt/c/work/REPO/src"), (9, "//server/x"), (10, None), (11, "/../work/repo/"), (12, "c:/work/Elsewhere")]
_CUT = "list_reduce(list_filter(string_split({0}, '/'), lambda x: x not in ('', '.')), lambda a, x: case when x = '..' then list_slice(a, 1, len(a) - 1) else list_append(a, x) end, []::varchar[])"
_PLACE = """{0} as (select id, path, case when regexp_matches(path, '^[A-Za-z]:[\\\\/]') then 'windows' when regexp_matches(path, '^/mnt/[A-Za-z](/|$)') then 'windows' when regexp_matches(path, '^/([^/]|$)') then 'posix' end as kind,
  case when regexp_matches(path, '^[A-Za-z]:[\\\\/]') then lower(path[1]) when regexp_matches(path, '^/mnt/[A-Za-z](/|$)') then lower(path[6]) else '' end as root,
  case when regexp_matches(path, '^[A-Za-z]:[\\\\/]') then {2} when regexp_matches(path, '^/mnt/[A-Za-z](/|$)') then {3} else {4} end as parts
  from {1})"""
_CUTS = [_CUT.format(x) for x in ("replace(lower(path[4:]), chr(92), '/')", "lower(path[7:])", "path")]
_LOCATED = _PLACE.format("located", dealt_values(PATHS, "id", "path"), *_CUTS) + ", " + _PLACE.format("known", values([p for p in PATHS if p[0] in (1, 7)], "id", "path"), *_CUTS)


def s5_locations(spark, sf_dir):
    rows = dealt(spark, sf_dir, PATHS, "id int, path string").withColumn("at", rec.location(F.col("path")))
    return rows.filter("at is not null").select("id", "at.kind", "at.root", F.array_join("at.parts", "/").alias("parts"))


def s6_path_relations(spark, sf_dir):
    """How each event's folder lies to two known ones."""
    at = F.col("path")
    here = dealt(spark, sf_dir, PATHS, "id int, path string").select("id", rec.location(at).alias("at"))
    there = literal(spark, [p for p in PATHS if p[0] in (1, 7)], "other int, path string").select("other", rec.location(at).alias("to"))
    both = here.withColumn("other", F.explode(F.array(F.lit(1), F.lit(7)))).join(F.broadcast(there), "other")
    return both.select("id", "other", rec.path_relation(F.col("at"), F.col("to")).alias("relation"))


_RELATION = """case when a.kind is null or b.kind is null then 'missing_unparseable' when a.kind <> b.kind or a.root <> b.root then 'unrelated' when a.parts = b.parts then 'exact'
  when list_slice(a.parts, 1, len(b.parts)) = b.parts then 'child' when list_slice(b.parts, 1, len(a.parts)) = a.parts then 'parent'
  when len(b.parts) > 0 and len(a.parts) >= len(b.parts) - 1 and list_slice(a.parts, 1, len(b.parts) - 1) = list_slice(b.parts, 1, len(b.parts) - 1) then 'sibling' else 'unrelated' end"""
RANKED = ("exact", "child", "parent", "sibling", "unrelated", "missing_unparseable")


def s7_discovery(spark, sf_dir):
    """Per kind of path: files by the best relation found."""
    found = s6_path_relations(spark, sf_dir)
    best = found.groupBy("id").agg(F.min(F.array_position(F.lit(list(RANKED)), F.col("relation"))).alias("rank"))
    return best.groupBy(F.get(F.lit(list(RANKED)), (F.col("rank") - 1).cast("int")).alias("relation")).agg(F.count("*").alias("n_files"))


def s8_session_identity(spark, sf_dir):
    """The first structured id of each file as its identity; files that share one are told."""
    found = table(spark, sf_dir, "conversations").filter("role <> 'system'").groupBy("conv_id").agg(F.min_by(F.concat(F.lit("s"), F.length("text") % 50), "turn").alias("session"))
    name = F.substring(F.sha2(F.concat(F.lit("agent"), F.lit("\0"), "session"), 256), 1, 16)
    return found.select("conv_id", name.alias("identity"), (F.count("*").over(Window.partitionBy(name)) > 1).alias("duplicate"))


def chat_export(spark, sf_dir):
    """Conversations as an export: one nested JSON document each."""
    body = F.array(F.struct(F.substring("text", 1, 40).alias("text")), F.struct(F.lit("").alias("text")), F.struct(F.substring("text", 41, 60).alias("text")))
    message = F.struct("turn", F.lower("role").alias("sender"), F.when(F.col("turn") % 3 == 2, F.col("text")).alias("text"), F.when(F.col("turn") % 3 != 2, body).alias("content"))
    packed = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(message)).alias("chat_messages"))
    return packed.select(F.to_json(F.struct(F.col("conv_id").alias("uuid"), "chat_messages")).alias("raw"))


EXPORT = "uuid long, chat_messages array<struct<turn:long,sender:string,text:string,content:array<struct<text:string>>>>"


def export_messages(exported):
    """Messages of nested exports: assembled text, mapped sender; those without text or with an unknown sender are left out."""
    rows = exported.select(F.from_json("raw", EXPORT).alias("c")).select("c.uuid", F.posexplode("c.chat_messages").alias("pos", "m"))
    parts = F.filter(F.transform("m.content", lambda x: x["text"]), lambda t: t != "")
    text = F.trim(F.coalesce(F.nullif(F.array_join(parts, "\n"), F.lit("")), F.col("m.text")))
    actor = F.when(F.col("m.sender").isin("human", "user"), "human").when(F.col("m.sender").isin("assistant", "ai"), "ai")
    return rows.select("uuid", "pos", actor.alias("actor"), text.alias("text"), F.col("m.sender").alias("sender"))


def s10_message_texts(spark, sf_dir):
    found = export_messages(chat_export(spark, sf_dir)).filter("text <> '' and actor is not null")
    return found.select("uuid", (F.row_number().over(Window.partitionBy("uuid").orderBy("pos"))).cast("long").alias("sequence"), "actor", F.sha2("text", 256).alias("text_sha256"))


def s11_unknown_senders(spark, sf_dir):
    return export_messages(chat_export(spark, sf_dir)).filter("actor is null").groupBy("sender").agg(F.count("*").alias("n"))


_BODY = "trim(case when turn % 3 = 2 then text else array_to_string(list_filter([text[1:40], text[41:100]], lambda x: x <> ''), chr(10)) end)"
_SENT = f"sent as (select conv_id, turn, lower(role) as sender, case lower(role) when 'user' then 'human' when 'assistant' then 'ai' end as actor, {_BODY} as body from conversations)"


def s13_import_identities(spark, sf_dir):
    """An explicit id, or a digest of place and content; how often it is given."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 4 != 0, F.concat(F.lit("id-"), F.col("doc_id") % 500)).alias("given"), F.sha2("text", 256).alias("content"), "source")
    name = F.coalesce("given", F.concat(F.lit("doc-"), rec.digest(rec.canonical(content="content", locator="source", record="doc_id"))))
    return docs.select("doc_id", name.alias("identity"), (F.count("*").over(Window.partitionBy(name)) > 1).alias("duplicate"))


def s14_project_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("text", F.when(F.col("doc_id") % 10 == 0, " ").otherwise(F.col("text")))
    name = txt.slug(F.concat("source", F.lit(" / "), "lang", F.lit(" #"), "doc_id"))
    return docs.filter(F.trim("text") != "").select("doc_id", name.alias("name"), F.octet_length("text").cast("long").alias("n_bytes"))


NAMES = list(enumerate(["notes.md", "config/.env", "API_Token.txt", "id_rsa", "tokenizer.py", "my-password-list.txt", "../up.txt", "/abs.txt", "a\\b.txt", "c:x.txt", "Notes.md", "dir/file.json", "dir/../file.json", "credentials", "auth.json", "x/id_ed25519", "id_ecdsa.pub", "server.pem", "pem.txt", "x.key", "keys.txt", "home/.netrc", ".npmrc", ".pypirc", "mytokens2.txt", ".env.local", "x.envy", "secrets/plain.txt", "CREDENTIALS.csv"], 1))


def s17_copied_files(spark, sf_dir):
    """Files of events that are copied: never those whose own name tells of secrets."""
    return dealt(spark, sf_dir, NAMES, "id int, name string").filter(~rec.sensitive_name(F.col("name"))).select("id", "name")


def s18_archive_members(spark, sf_dir):
    """Names of an archive that are refused, and why."""
    # an archive for each few events, so that names meet
    archive = F.floor(F.col("id") / len(NAMES))
    rows = dealt(spark, sf_dir, NAMES, "id int, name string").withColumn("n", F.count("*").over(Window.partitionBy(archive, F.lower("name"))))
    code = F.when(F.col("name").startswith("/") | F.col("name").rlike("^[A-Za-z]:"), "absolute").when(F.col("name").contains("\\"), "backslash").when(F.array_contains(F.split("name", "/"), ".."), "climbs").when(F.col("n") > 1, "same_name")
    return rows.select("id", code.alias("code")).filter("code is not null")


def k2_array_rows(spark, sf_dir):
    """One JSON array per conversation, inserted as rows again."""
    packed = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.to_json(F.collect_list(F.struct("turn", "role"))).alias("rows"))
    return packed.select("conv_id", F.explode(F.from_json("rows", "array<struct<turn:long,role:string>>")).alias("r")).select("conv_id", "r.turn", "r.role")


def c1_canonical_rows(spark, sf_dir):
    line = rec.canonical(source="source", doc_id="doc_id", lang="lang", text="text", missing=F.lit(None).cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", rec.digest(line).alias("digest"), F.octet_length(line).cast("long").alias("n_bytes"))


def c6_corpus_digest(spark, sf_dir):
    """One digest for each conversation over its turns in order, and the size of what was read."""
    turns = table(spark, sf_dir, "conversations")
    return rec.ordered_digest(turns, ["conv_id"], ["turn"], rec.canonical(turn="turn", role="role", text="text"))


def c5_row_digests(spark, sf_dir):
    """Digests of imported items, by document: how many differ, and the digest of all of them in order."""
    rows = conversation_items(spark, sf_dir).withColumn("d", rec.digest(rec.canonical(content="content", eventType="event_type", id="item_id", sequence="sequence")))
    packed = rows.groupBy("document_id").agg(F.countDistinct("d").alias("n_distinct"), F.array_sort(F.collect_list(F.struct("sequence", "d"))).alias("all"))
    return packed.select("document_id", "n_distinct", F.sha2(F.array_join(F.transform("all", lambda x: x["d"]), ""), 256).alias("digest"))


def c7_json_paths(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.get_json_object("props", "$.none").alias("none"))


def c9_checksums(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.crc32(F.encode(F.col("lang"), "UTF-8")).alias("crc")).agg(F.count("*").alias("n"))


def i3_rewritten_ids(spark, sf_dir):
    """References to events as the ids that those got; references to dropped events go."""
    events = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") != "view", F.concat(F.lit("evt-"), F.sha2(F.col("event_id").cast("string"), 256))).alias("new_id"))
    kept = events.filter("new_id is not null")
    refs = kept.select("new_id", F.explode(F.array(F.col("event_id") - 1, F.col("event_id") * 2, F.col("event_id") - 7)).alias("to"))
    return refs.join(kept.select(F.col("event_id").alias("to"), F.col("new_id").alias("ref")), "to").groupBy("new_id").agg(F.count("*").alias("n_refs"), F.min("ref").alias("least"))


def i4_meeting_record_ids(spark, sf_dir):
    """A given id if it is well formed, else a digest of the content and its nth occurrence."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.when(F.col("turn") % 2 == 0, F.concat(F.lit("rec-"), F.lpad((F.col("turn") + 1).cast("string"), 5, "0"))).when(F.col("turn") % 3 == 0, "bad id").alias("given"))
    nth = F.row_number().over(Window.partitionBy("conv_id", "text").orderBy("turn"))
    name = F.when(F.col("given").rlike("^rec-[0-9]{5}$"), F.col("given")).otherwise(F.concat(F.lit("rec-"), F.sha2(F.concat_ws(":", "text", nth), 256)))
    return turns.select("conv_id", "turn", name.alias("record_id"))


def i6_last_messages(spark, sf_dir):
    """Completion notes kept only where no turn says the same."""
    turns = table(spark, sf_dir, "conversations")
    notes = turns.groupBy("conv_id").agg(F.max_by("text", "turn").alias("last")).select("conv_id", F.when(F.col("conv_id") % 3 == 0, F.concat("last", F.lit("!"))).otherwise(F.col("last")).alias("text"))
    return notes.join(turns.select("conv_id", "text"), ["conv_id", "text"], "left_anti").select("conv_id", F.length("text").cast("long").alias("n_chars"))


def i7_duplicate_units(spark, sf_dir):
    """Orders as units, one in seven a duplicate of another: faults of that relation."""
    units = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 7 == 0, "duplicate").otherwise("work").alias("kind"), F.when(F.col("o_orderkey") % 7 == 0, F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderkey")).otherwise(F.col("o_orderkey") - F.col("o_orderkey") % 11)).when(F.col("o_orderkey") % 97 == 0, 1).alias("of"))
    is_copy, named = F.col("kind") == "duplicate", F.col("of").isNotNull()
    alone = F.when(is_copy != named, "kind").when(is_copy & (F.col("of") == F.col("id")), "itself")
    faulty = units.select("id", alone.alias("code")).filter("code is not null")
    # only a duplicate of another unit is looked up: what names none, or may not, does not meet in one task
    asked = units.filter(is_copy & named & (F.col("of") != F.col("id"))).select("id", "of")
    other = units.select(F.col("id").alias("of"), F.col("kind").alias("of_kind"))
    code = F.when(F.col("of_kind").isNull(), "unknown").when(F.col("of_kind") == "duplicate", "chain")
    return faulty.unionByName(asked.join(other, "of", "left").select("id", code.alias("code")).filter("code is not null"))


QUERIES = {f.__name__: f for f in (s1_jsonl_scan, s1_refused_lines, s3_bounded_scan, s4_structured_cwd, s5_locations, s6_path_relations, s7_discovery, s8_session_identity, s10_message_texts, s11_unknown_senders, s13_import_identities, s14_project_documents, s17_copied_files, s18_archive_members, k2_array_rows, c1_canonical_rows, c6_corpus_digest, c5_row_digests, c7_json_paths, c9_checksums, i3_rewritten_ids, i4_meeting_record_ids, i6_last_messages, i7_duplicate_units)}

ORACLE = {
    "s1_jsonl_scan": f"select conv_id as file, turn + 1 as line, concat_ws('-', 'e', conv_id, turn) as event_id, lower(role) as type, length(text) as n_chars from conversations where {_GOOD}",
    "s1_refused_lines": f"select conv_id as file, count(*) as n_refused from conversations where {_N} % 11 <> 5 and {_N} % 7 = 3 group by 1",
    "s3_bounded_scan": "with t as (select conv_id as file, row_number() over w as nth, sum(strlen(text)) over w as bytes from conversations window w as (partition by conv_id order by turn rows unbounded preceding)) select file, count(*) filter (nth <= 4 and bytes <= 3000) as n_read, cast(max(bytes) filter (nth <= 4 and bytes <= 3000) as bigint) as n_bytes, bool_or(not (nth <= 4 and bytes <= 3000)) as stopped from t group by 1",
    "s4_structured_cwd": f"select file, line, coalesce(case when json_extract_string(raw, '$.type') in ('session_meta', 'turn_context') then json_extract_string(raw, '$.payload.cwd') end, json_extract_string(raw, '$.cwd')) as cwd from {dealt_values(META, 'file', 'line', 'raw')} m",
    "s5_locations": f"with {_LOCATED} select id, kind, root, array_to_string(parts, '/') as parts from located where kind is not null",
    "s6_path_relations": f"with {_LOCATED} select a.id, b.id as other, {_RELATION} as relation from located a, known b",
    "s7_discovery": f"with {_LOCATED}, r as (select a.id, min(list_position({list(RANKED)}, {_RELATION})) as rank from located a, known b group by 1) select {list(RANKED)}[rank] as relation, count(*) as n_files from r group by 1",
    "s8_session_identity": "with f as (select conv_id, min_by('s' || length(text) % 50, turn) as s from conversations where role <> 'system' group by 1) select conv_id, sha256('agent' || chr(0) || s)[1:16] as identity, count(*) over (partition by s) > 1 as duplicate from f",
    "s10_message_texts": f"with {_SENT} select conv_id as uuid, row_number() over (partition by conv_id order by turn) as sequence, actor, sha256(body) as text_sha256 from sent where body <> '' and actor is not null",
    "s11_unknown_senders": f"with {_SENT} select sender, count(*) as n from sent where actor is null group by 1",
    "s13_import_identities": """with n as (select doc_id, case when doc_id % 4 <> 0 then 'id-' || doc_id % 500 else 'doc-' || sha256(to_json({content: sha256(text), locator: source, record: doc_id})) end as identity from documents) select doc_id, identity, count(*) over (partition by identity) > 1 as duplicate from n""",
    "s14_project_documents": "select doc_id, regexp_replace(source || ' / ' || lang || ' #' || doc_id, '[^A-Za-z0-9._-]+', '-', 'g') as name, strlen(text) as n_bytes from documents where doc_id % 10 <> 0 and trim(text) <> ''",
    "s17_copied_files": f"select id, name from {dealt_values(NAMES, 'id', 'name')} m where not regexp_matches(regexp_extract(name, '[^/]*$'), '(auth\\.json|\\.credentials\\.json|credentials|\\.env(\\.|$)|id_rsa|id_ed25519|id_ecdsa|\\.pem$|\\.key$|token|secret|password|\\.netrc|\\.npmrc|\\.pypirc)', 'i')",
    "s18_archive_members": f"with c as (select id, case when name like '/%' or regexp_matches(name, '^[A-Za-z]:') then 'absolute' when contains(name, chr(92)) then 'backslash' when list_contains(string_split(name, '/'), '..') then 'climbs' when count(*) over (partition by id // {len(NAMES)}, lower(name)) > 1 then 'same_name' end as code from {dealt_values(NAMES, 'id', 'name')} m) select * from c where code is not null",
    "k2_array_rows": "select conv_id, turn, role from conversations",
    "c1_canonical_rows": "with l as (select doc_id, to_json({doc_id: doc_id, lang: lang, missing: null::varchar, source: source, text: text}) as j from documents) select doc_id, sha256(j) as digest, strlen(j) as n_bytes from l",
    "c6_corpus_digest": "with l as (select conv_id, turn, to_json({role: role, text: text, turn: turn})::varchar as j from conversations) select conv_id, sha256(string_agg(j || chr(10), '' order by turn)) as digest, cast(sum(strlen(j) + 1) as bigint) as n_bytes, count(*) as n_rows from l group by 1",
    "c5_row_digests": "with l as (select 'conv-' || conv_id as document_id, turn, sha256(to_json({content: text, eventType: 'message', id: 'conv-' || conv_id || ':turn-' || turn, sequence: turn + 1})) as d from conversations) select document_id, count(distinct d) as n_distinct, sha256(string_agg(d, '' order by turn)) as digest from l group by 1",
    "c7_json_paths": "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k, json_extract_string(props, '$.none') as none from events",
    "i3_rewritten_ids": "with k as (select event_id, 'evt-' || sha256(event_id::varchar) as new_id from events where event_type <> 'view'), r as (select new_id, unnest([event_id - 1, event_id * 2, event_id - 7]) as t from k) select r.new_id, count(*) as n_refs, min(k.new_id) as least from r join k on k.event_id = r.t group by 1",
    "i4_meeting_record_ids": "select conv_id, turn, case when turn % 2 = 0 then 'rec-' || lpad((turn + 1)::varchar, 5, '0') else 'rec-' || sha256(text || ':' || row_number() over (partition by conv_id, text order by turn)) end as record_id from conversations",
    "i6_last_messages": "with n as (select conv_id, max_by(text, turn) as last from conversations group by 1), m as (select conv_id, case when conv_id % 3 = 0 then last || '!' else last end as text from n) select conv_id, length(text) as n_chars from m where not exists (select 1 from conversations c where c.conv_id = m.conv_id and c.text = m.text)",
    "i7_duplicate_units": """with u as (select o_orderkey as id, case when o_orderkey % 7 = 0 then 'duplicate' else 'work' end as kind, case when o_orderkey % 7 = 0 then case when o_orderkey % 5 = 0 then o_orderkey else o_orderkey - o_orderkey % 11 end when o_orderkey % 97 = 0 then 1 end as of_id from orders),
      c as (select u.id, case when (u.kind = 'duplicate') <> (u.of_id is not null) then 'kind' when u.kind = 'duplicate' and u.of_id = u.id then 'itself' when u.kind = 'duplicate' and o.kind is null then 'unknown' when u.kind = 'duplicate' and o.kind = 'duplicate' then 'chain' end as code from u left join u o on o.id = u.of_id) select * from c where code is not null""",
}
