"""Schemas that drift between the files of a stream of JSON lines.

1. ``profiles`` parses the lines once and folds them, per input partition, to
   one row per (file, field): type counts, a bottom-k sketch of the values and
   a bottom-k sketch of their shapes.  Partial profiles are merged in two
   rounds, so that a file spread over any number of partitions is never
   gathered whole.
2. ``layouts`` keeps, per file, the fields that are non-null in more than half
   of its parseable lines.
3. ``changes`` joins each layout with that of the file before and solves a
   bipartite matching between the fields that vanished and those that came up,
   weighted by values, shapes, types and names.
4. ``unified`` follows the renames through each stream and reads all lines
   into one table; ``rejects`` has the lines it can't read.

Lines that don't parse as a JSON object, empty and null lines are counted per
file.  A file without a parseable line has no layout and is passed over.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from collections.abc import Callable, Iterable, Iterator
from datetime import UTC, datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tasklathe.shared import written

SKETCH = 48  # values a bottom-k sketch keeps
MATCH_AT = 0.45  # least score at which two fields are taken to be one
PARTIALS = 256  # input partitions whose profiles the first merge round gathers

# Names the task metadata and the payload have in the record format.
METADATA_FIELDS = ("timestamp_millis", "source_application_id", "source_instance_id", "retry_count", "scheduled_time_millis")
# JSON types in the order that decides a tie.
TYPES = ("string", "integer", "number", "boolean", "object", "array")

PROFILE = "stream_no bigint, file_no int, salt int, parent string, name string, n array<bigint>, vals array<bigint>, shapes array<string>"

_INTEGER = re.compile(r"-?[0-9]+")
SHORT_SHAPE = 24  # characters up to which a shape is its own name; a longer one goes by its hash
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
_HEX = re.compile(r"[0-9a-f]{6,}")
_DIGIT = re.compile(r"\d")
_MIXED = re.compile(r"[0-9a-f]*\d[0-9a-f]*")
_KINDS = {str: "string", int: "integer", float: "number", bool: "boolean", dict: "object", list: "array"}
_PLACE = {k: TYPES.index(v) for k, v in _KINDS.items()}
_ISO = re.compile(r"\d{4}-\d\d-\d\d[T ]\d\d:\d\d")
_KEY = re.compile(r'"(\w+)"\s*:')


def json_type(v: object) -> str:
    return _KINDS[type(v)]


def _hash(x: str) -> int:
    return int.from_bytes(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big") >> 1


def _text_shape(s: str) -> set[str]:
    if _ISO.match(s):
        return {"time"}
    if _INTEGER.fullmatch(s):
        return _digits_shape(s)
    t = s
    if len(s) >= 12 and _BASE64.fullmatch(s):
        try:
            t = base64.b64decode(s + "=" * (-len(s) % 4), altchars=b"-_" if ("-" in s or "_" in s) else None).decode("utf-8", "strict")
        except (ValueError, UnicodeDecodeError):
            t = s
    if t.lstrip()[:1] == "{":
        return {f"key:{k}" for k in _KEY.findall(t)} or {"record"}
    if _HEX.fullmatch(s):
        return {f"hex{len(s)}"}
    if not _DIGIT.search(s):
        return {"words"}
    shape = _MIXED.sub("9", s)
    return {shape if len(shape) <= SHORT_SHAPE else f"long{_hash(shape):x}"}


def _digits_shape(s: str) -> set[str]:
    n = len(s.lstrip("-").lstrip("0")) or 1
    return {"time" if n == 13 else f"num{n}"}


def _number_shape(v: float) -> set[str]:
    if v != v or v in (float("inf"), float("-inf")):
        return {"num0"}
    return _digits_shape(f"{int(v):x}" if abs(v) >= 1e300 else str(int(v)))


def value_facts(v: object) -> tuple[list[str], set[str]]:
    """Canonical values and shapes: the same content in another JSON type gives the same ones where it can."""
    if isinstance(v, bool):
        return [f"b{v}"], {"bool"}
    if isinstance(v, (int, float)):
        return [f"{v:x}" if isinstance(v, int) and abs(v) >= 10**300 else str(v)], _number_shape(v)
    if isinstance(v, str):
        return [v], _text_shape(v)
    if isinstance(v, dict):
        return [str(x) for x in v.values() if isinstance(x, (str, int)) and not isinstance(x, bool)], {f"key:{k}" for k in v}
    if v and all(isinstance(x, int) and 0 <= x < 256 for x in v):
        text = bytes(v).decode("utf-8", "replace")
        return [text], _text_shape(text) if text.lstrip()[:1] == "{" else {"bytes"}
    return [str(x) for x in v], {"list"}


class _Field:
    __slots__ = ("n", "vals", "shapes")

    def __init__(self):
        self.n, self.vals, self.shapes = [0] * len(TYPES), set(), {}

    def add(self, v: object) -> None:
        self.n[_PLACE[type(v)]] += 1
        values, shapes = value_facts(v)
        self.vals.update(_hash(x) for x in values)
        if len(self.vals) > 8 * SKETCH:
            self.vals = set(sorted(self.vals)[:SKETCH])
        for s in map(_clean, shapes):
            self.shapes[s] = self.shapes.get(s, 0) + 1
        if len(self.shapes) > 8 * SKETCH:
            self.shapes = {s: self.shapes[s] for s in _bottom(self.shapes)}

    def merge(self, n, vals, shapes) -> None:
        self.n = [a + int(b) for a, b in zip(self.n, n)]
        self.vals = set(sorted(self.vals | {int(x) for x in vals})[:SKETCH])
        for s in shapes:
            k, _, c = s.rpartition("\x1f")
            self.shapes[k] = self.shapes.get(k, 0) + int(c)
        self.shapes = {s: self.shapes[s] for s in _bottom(self.shapes)}

    def row(self) -> tuple:
        return self.n, sorted(self.vals)[:SKETCH], [f"{s}\x1f{self.shapes[s]}" for s in _bottom(self.shapes)]


def _bottom(shapes: dict[str, int]) -> list[str]:
    return sorted(shapes, key=_hash)[:SKETCH]


def _clean(s: str) -> str:
    """Text without lone surrogates, which JSON may escape but no column can hold."""
    return s if s.isascii() else s.encode("utf-8", "replace").decode()


def parse_object(line: str | None) -> dict | None:
    """The JSON object on a line; None for anything else, however broken or deep."""
    if not line:
        return None
    try:
        o = json.loads(line)
    except RecursionError:
        return None
    except ValueError:
        try:  # numbers of thousands of digits are read as floats
            o = json.loads(line, parse_int=float)
        except (ValueError, RecursionError):
            return None
    return o if isinstance(o, dict) else None


def rejects(lines: DataFrame) -> DataFrame:
    """Lines that ``unified`` leaves out: the columns stream_no, file_no, line_no, line and reason.

    reason: null, empty, no object (JSON of another kind), broken, or no place
    (a line without stream or file number, whatever it holds).
    """

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            why = []
            for s, f, line in zip(pdf["stream_no"], pdf["file_no"], pdf["line"]):
                if s != s or s is None or f != f or f is None:
                    why.append("no place")
                elif line is None:
                    why.append("null")
                elif not line.strip():
                    why.append("empty")
                elif parse_object(line) is not None:
                    why.append(None)
                else:
                    try:
                        json.loads(line)
                        why.append("no object")
                    except (ValueError, RecursionError):
                        why.append("broken")
            got = pdf.assign(reason=why)
            yield got[got["reason"].notna()].astype({"stream_no": "Int64", "file_no": "Int64", "line_no": "Int64"})

    return lines.select("stream_no", "file_no", "line_no", "line").mapInPandas(run, "stream_no bigint, file_no int, line_no int, line string, reason string")


def _partial(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyspark.taskcontext import TaskContext

    salt = TaskContext.get().partitionId() // PARTIALS
    held: dict[tuple, _Field] = {}

    def field(key: tuple) -> _Field:
        f = held.get(key)
        if f is None:
            f = held[key] = _Field()
        return f

    for pdf in pdfs:
        for stream, file, line in zip(pdf["stream_no"], pdf["file_no"], pdf["line"]):
            o = parse_object(line)
            head = field((stream, file, None, ""))
            if o is None:
                head.n[1] += 1
                continue
            head.n[0] += 1
            for k, v in o.items():
                if v is None:
                    continue
                k = _clean(k)
                if k:
                    field((stream, file, None, k)).add(v)
                if isinstance(v, dict):
                    for k2, v2 in v.items():
                        if v2 is not None:
                            field((stream, file, k, _clean(k2))).add(v2)
        if len(held) > 20_000:  # rows of many files: hand over what there is, the merge adds it up
            yield _rows(held, salt)
            held.clear()
    if held:
        yield _rows(held, salt)


def _rows(held: dict[tuple, _Field], salt: int) -> pd.DataFrame:
    names = [f.split()[0] for f in PROFILE.split(", ")]
    return pd.DataFrame([(*k[:2], salt, *k[2:], *f.row()) for k, f in held.items()], columns=names)


def _merge(pdfs: Iterator[pd.DataFrame], done: Callable[[tuple, dict[tuple, _Field]], Iterator[tuple]], columns: list[str]) -> Iterator[pd.DataFrame]:
    """Merge partial profiles, which come file by file (and salt by salt), and hand on what ``done`` makes of each."""
    held: dict[tuple, _Field] = {}
    at = None
    for pdf in pdfs:
        rows: list[tuple] = []
        for s, f, salt, p, k, n, vals, shapes in pdf.itertuples(index=False):
            if (s, f, salt) != at:
                if held:
                    rows.extend(done(at, held))
                held, at = {}, (s, f, salt)
            x = held.get((p, k))
            if x is None:
                x = held[p, k] = _Field()
            x.merge(n, vals, shapes)
        yield pd.DataFrame(rows, columns=columns)
    if held:
        yield pd.DataFrame(list(done(at, held)), columns=columns)


def _as_profile(at: tuple, held: dict[tuple, _Field]) -> Iterator[tuple]:
    for (p, k), x in held.items():
        yield (*at, p, k, *x.row())


def _as_layout(at: tuple, held: dict[tuple, _Field]) -> Iterator[tuple]:
    """The fields non-null in more than half of a file's lines."""
    good, bad = held.pop((None, "")).n[:2]
    if not good:
        return
    fields = []
    for (p, k), x in held.items():
        if sum(x.n) * 2 > good:
            n, vals, shapes = x.row()
            fields.append({"parent": p, "name": k, "type": TYPES[n.index(max(n))], "vals": vals, "shapes": shapes})
    fields.sort(key=lambda x: (x["parent"] or "", x["name"]))
    yield (*at[:2], good, bad, fields)


LAYOUT = "stream_no bigint, file_no int, n_lines bigint, n_bad bigint, fields array<struct<parent:string,name:string,type:string,vals:array<bigint>,shapes:array<string>>>"


def profiles(lines: DataFrame) -> DataFrame:
    """Partial profiles of the fields of every file, at most one per field and PARTIALS input partitions.

    The row with the empty name counts lines parsed and not parsed in ``n``.
    Lines without stream or file number are left out.
    """
    some = lines.filter("stream_no is not null and file_no is not null").select("stream_no", "file_no", "line")
    names = [f.split()[0] for f in PROFILE.split(", ")]
    by = ["stream_no", "file_no", "salt"]
    partial = some.mapInPandas(_partial, PROFILE)
    return partial.repartition(*by).sortWithinPartitions(*by).mapInPandas(lambda it: _merge(it, _as_profile, names), PROFILE)


def layouts(profile: DataFrame) -> DataFrame:
    """One row per file: stream_no, file_no, n_lines, n_bad, fields (array of parent, name, type, vals, shapes), as a written table."""
    by = ["stream_no", "file_no"]
    one = profile.withColumn("salt", F.lit(0)).repartition(*by).sortWithinPartitions(*by)
    names = ["stream_no", "file_no", "n_lines", "n_bad", "fields"]
    return written(one.mapInPandas(lambda it: _merge(it, _as_layout, names), LAYOUT), "layouts")


# --- matching ----------------------------------------------------------------


def name_tokens(name: str) -> list[str]:
    return [t for t in re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name).lower().split("_") if t]


def _short_for(a: str, b: str) -> bool:
    """Is ``a`` a shortening of ``b``: same first letter, its letters in order in ``b``?"""
    if len(a) > len(b):
        a, b = b, a
    it = iter(b)
    return bool(a) and a[0] == b[0] and all(c in it for c in a)


def name_similarity(a: str, b: str) -> float:
    """1 for the same words in another spelling; a shortened word counts nearly as the whole."""
    x, y = name_tokens(a), name_tokens(b)
    if not x or not y:
        return 0.0
    if "".join(x) == "".join(y):
        return 1.0
    left, got = list(y), 0.0
    for t in x:
        u = next((u for u in left if u == t), None)
        w = 1.0
        if u is None:
            u, w = next((u for u in left if _short_for(t, u)), None), 0.8
        if u is not None:
            left.remove(u)
            got += w
    return 2 * got / (len(x) + len(y))


def _overlap(a, b) -> float:
    """Containment of bottom-k sketches: share of the smaller one's values within the range both cover."""
    a, b = {int(x) for x in a}, {int(x) for x in b}
    if not a or not b:
        return 0.0
    top = min(max(a) if len(a) >= SKETCH else 2**64, max(b) if len(b) >= SKETCH else 2**64)
    a, b = {x for x in a if x <= top}, {x for x in b if x <= top}
    return len(a & b) / max(1, min(len(a), len(b)))


def _shape_likeness(a, b) -> float:
    def weigh(x):
        d = {k: int(c) for k, _, c in (s.rpartition("\x1f") for s in x)}
        n = max(d.values(), default=1)
        return {k: min(1.0, c / n) for k, c in d.items()}

    x, y = weigh(a), weigh(b)
    keys = x.keys() | y.keys()
    return sum(min(x.get(k, 0), y.get(k, 0)) for k in keys) / max(1e-9, sum(max(x.get(k, 0), y.get(k, 0)) for k in keys))


def match_score(old: dict, new: dict) -> float:
    """How likely the content and role of ``old`` go on in ``new``, from 0 to 1.

    Values that recur settle it.  Without any, fields whose values repeat (few
    distinct ones) are two different things unless the type changed too; fields
    whose values never repeat are compared by shape, names deciding among those
    of a shape that many fields share.
    """
    values, shape, name = _overlap(old["vals"], new["vals"]), _shape_likeness(old["shapes"], new["shapes"]), name_similarity(old["name"], new["name"])
    record = any(s.startswith("key:") for s in old["shapes"]) and any(s.startswith("key:") for s in new["shapes"])
    if values >= 0.3:
        return 0.45 + 0.25 * values + 0.15 * shape + 0.15 * name
    if record:
        return 0.25 + 0.6 * shape + 0.15 * name if shape >= 0.3 else 0.2 * name
    same_type = old["type"] == new["type"]
    if not same_type and shape < 0.5:
        return 0.6 * name
    few = min(len(old["vals"]), len(new["vals"])) < SKETCH // 4
    if few and same_type:
        return 0.3 * name + 0.1 * shape + 0.2 * values
    return 0.1 * shape + 0.5 * name + 0.2 * values


def best_matching(scores: list[list[float]]) -> list[tuple[int, int]]:
    """Pairs (row, column) of a one-to-one matching with the greatest sum of scores (Hungarian method)."""
    if not scores or not scores[0]:
        return []
    n, m = len(scores), len(scores[0])
    flip = n > m
    cost = [[-scores[i][j] for i in range(n)] for j in range(m)] if flip else [[-x for x in r] for r in scores]
    n, m = len(cost), len(cost[0])
    u, v, match = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used, way = [float("inf")] * (m + 1), [False] * (m + 1), [0] * (m + 1)
        while True:
            used[j0] = True
            i0, delta, j1 = match[j0], float("inf"), 0
            for j in range(1, m + 1):
                if not used[j]:
                    c = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if c < least[j]:
                        least[j], way[j] = c, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(m + 1):
                if used[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    pairs = [(match[j] - 1, j - 1) for j in range(1, m + 1) if match[j]]
    return [(b, a) for a, b in pairs] if flip else pairs


def _alone(f: dict, fields: list[dict]) -> bool:
    """Has no other field of the layout shapes like this one's?"""
    return all(g is f or _shape_likeness(f["shapes"], g["shapes"]) < 0.5 for g in fields)


def _renames(gone: list[dict], came: list[dict], old: list[dict], new: list[dict]) -> list[tuple[dict, dict]]:
    """Pairs of fields that vanished and came up and are taken to be one. old, new: all fields of the two layouts.

    A pair without common values still matches where many values of one type
    have a shape that no other field has, before or after.
    """
    scores = [[match_score(o, n) for n in came] for o in gone]
    if gone and came:
        lone = {id(f): _alone(f, fs) for some, fs in ((gone, old), (came, new)) for f in some}
        many = lambda f: len(f["vals"]) >= SKETCH // 4
        for i, o in enumerate(gone):
            for j, n in enumerate(came):
                if scores[i][j] < MATCH_AT and o["type"] == n["type"] and many(o) and many(n) and lone[id(o)] and lone[id(n)]:
                    shape = _shape_likeness(o["shapes"], n["shapes"])
                    if shape >= 0.5:
                        scores[i][j] = MATCH_AT + 0.1 * (shape - 0.5) + 0.1 * name_similarity(o["name"], n["name"])
    # below the threshold a pair is worth nothing, so it can't push out a good one
    scores = [[s if s >= MATCH_AT else 0.0 for s in r] for r in scores]
    return [(gone[i], came[j]) for i, j in best_matching(scores) if scores[i][j] >= MATCH_AT]


def metadata_parent(fields: list[dict], before: str | None) -> str | None:
    """The top-level object whose fields are most like those of the task metadata; ``before``: its name so far."""
    best, top = None, 0.9
    for f in fields:
        if f["parent"] is None and f["type"] == "object":
            own = [g["name"] for g in fields if g["parent"] == f["name"]]
            score = sum(max((name_similarity(k, m) for k in own), default=0) >= 0.6 for m in METADATA_FIELDS) + 0.5 * (f["name"] == before) + 0.25 * ("meta" in f["name"].lower())
            if score > top:
                best, top = f["name"], score
    return best


def layout_changes(old: list[dict], new: list[dict]) -> list[tuple[str, str, str | None, str]]:
    """Changes between two layouts: (field_path, change_kind, new_path, new_type)."""
    m_old = metadata_parent(old, None)
    m_new = metadata_parent(new, m_old)
    rows: list[tuple[str, str, str | None, str]] = []
    tops = lambda fs: {f["name"]: f for f in fs if f["parent"] is None}
    below = lambda fs, p: {f["name"]: f for f in fs if p is not None and f["parent"] == p}

    def scope(a: dict[str, dict], b: dict[str, dict], pre: str) -> None:
        gone, came = [a[k] for k in sorted(a) if k not in b], [b[k] for k in sorted(b) if k not in a]
        pairs = _renames(gone, came, list(a.values()), list(b.values()))
        moved = {o["name"] for o, _ in pairs}, {n["name"] for _, n in pairs}
        rows.extend((pre + o["name"], "renamed", pre + n["name"], n["type"]) for o, n in pairs)
        rows.extend((pre + o["name"], "removed", None, o["type"]) for o in gone if o["name"] not in moved[0])
        rows.extend((pre + n["name"], "added", pre + n["name"], n["type"]) for n in came if n["name"] not in moved[1])
        rows.extend((pre + k, "type_changed", pre + k, b[k]["type"]) for k in sorted(a) if k in b and a[k]["type"] != b[k]["type"])

    scope(tops(old), tops(new), "")
    if m_old is not None and m_old == m_new:
        scope(below(old, m_old), below(new, m_old), f"{m_old}.")
    return rows


def _compare(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["stream_no", "file_no", "field_path", "change_kind", "new_path", "new_type"]
    as_dicts = lambda fs: [] if fs is None else [f if isinstance(f, dict) else f.asDict() for f in fs]
    for pdf in pdfs:
        rows = []
        for s, f, old, new in zip(pdf["stream_no"], pdf["file_no"], pdf["old_fields"], pdf["fields"]):
            rows += [(s, f, *c) for c in layout_changes(as_dicts(old), as_dicts(new))]
        yield pd.DataFrame(rows, columns=names)


def changes(layout: DataFrame) -> DataFrame:
    """One row per change between a file and the one before: stream_no, file_no, field_path, change_kind, new_path, new_type.

    Only file numbers go through the window over a stream; layouts meet in a
    join on (stream, file), so a long stream is not gathered in a task.
    """
    w = Window.partitionBy("stream_no").orderBy("file_no")
    order = layout.select("stream_no", "file_no").withColumn("prev_no", F.lag("file_no").over(w)).filter("prev_no is not null")
    old = layout.select("stream_no", F.col("file_no").alias("prev_no"), F.col("fields").alias("old_fields"))
    pairs = order.join(old, ["stream_no", "prev_no"]).join(layout.select("stream_no", "file_no", "fields"), ["stream_no", "file_no"])
    schema = "stream_no bigint, file_no int, field_path string, change_kind string, new_path string, new_type string"
    return pairs.select("stream_no", "file_no", "old_fields", "fields").mapInPandas(_compare, schema)


# --- one table ---------------------------------------------------------------


def _follow(pdf: pd.DataFrame) -> pd.DataFrame:
    """One stream's renames: the names of each renamed field, and the file from which each holds."""
    rows, origin = [], {}
    s = pdf["stream_no"].iloc[0]
    for f, old, new in sorted(zip(pdf["file_no"], pdf["field_path"], pdf["new_path"])):
        first = origin.pop(old, None)
        if first is None:
            # a name that was used before by another field is told apart by the file it came up in
            first = old
            rows.append((s, first, -1, old))
        origin[new] = first
        rows.append((s, first, f, new))
    return pd.DataFrame(rows, columns=["stream_no", "canonical", "file_from", "path"]).drop_duplicates(["stream_no", "canonical", "file_from"], keep="last")


def canonical_names(change: DataFrame) -> DataFrame:
    """stream_no, canonical, file_from, path: under which path a field, first called ``canonical``, goes from a file on. About a row per rename."""
    schema = "stream_no bigint, canonical string, file_from int, path string"
    return change.filter("change_kind = 'renamed'").select("stream_no", "file_no", "field_path", "new_path").groupBy("stream_no").applyInPandas(_follow, schema)


def names_in_files(files: DataFrame, alias: DataFrame) -> DataFrame:
    """stream_no, file_no, names: per file a map from the paths in use to the canonical ones.

    Each file meets its stream's renamed fields (few), not its renames: the
    path in effect is the last one before, in a window over the stream's files
    per field.
    """
    fields = alias.select("stream_no", "canonical").distinct()
    asked = files.join(fields, "stream_no").select("stream_no", "canonical", "file_no", F.lit(None).cast("struct<path:string,since:int>").alias("at"), F.lit(1).alias("asked"))
    said = alias.select("stream_no", "canonical", F.col("file_from").alias("file_no"), F.struct("path", F.col("file_from").alias("since")).alias("at"), F.lit(0).alias("asked"))
    w = Window.partitionBy("stream_no", "canonical").orderBy("file_no", "asked").rowsBetween(Window.unboundedPreceding, 0)
    now = asked.unionByName(said).withColumn("at", F.last("at", ignorenulls=True).over(w)).filter("asked = 1 and at is not null")
    # a name may have belonged to another field before: the one that took it last has it
    owner = now.groupBy("stream_no", "file_no", F.col("at.path").alias("path")).agg(F.max_by("canonical", F.struct("at.since", "canonical")).alias("canonical"))
    return owner.groupBy("stream_no", "file_no").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("path", "canonical")))).alias("names"))


def _role(name: str) -> str | None:
    """The metadata field that a name is a spelling of."""
    return next((m for m in METADATA_FIELDS if name_similarity(name, m) >= 0.999), None)


def _millis(v: object) -> int | None:
    """A whole number of 64 bits, or the epoch milliseconds of an ISO time; None for anything else."""
    if isinstance(v, bool) or v is None:
        return None
    if isinstance(v, (int, float)):
        return int(v) if abs(v) < 2**63 and v == int(v) else None
    s = str(v)
    if _INTEGER.fullmatch(s):
        n = int(s) if len(s) < 40 else 2**63
        return n if abs(n) < 2**63 else None
    if _ISO.match(s):
        try:
            t = datetime.fromisoformat(s)
        except ValueError:
            return None
        t = t.replace(tzinfo=UTC) if t.tzinfo is None else t
        return (t - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(milliseconds=1)
    return None


def _payload(v: object) -> bytes | None:
    if v is None:
        return None
    if isinstance(v, dict):
        return json.dumps(v, separators=(",", ":"), ensure_ascii=False).encode("utf-8", "replace")
    if isinstance(v, list):
        return bytes(v) if all(isinstance(x, int) and 0 <= x < 256 for x in v) else json.dumps(v).encode()
    s = str(v)
    try:
        return base64.b64decode(s, validate=True)
    except ValueError:
        return s.encode("utf-8", "replace")


UNIFIED = (
    "stream_no bigint, file_no int, line_no int, timestamp_millis bigint, source_application_id string, source_instance_id string,"
    " retry_count bigint, scheduled_time_millis bigint, serialized_task binary, extra map<string,string>"
)


def _text(v: object) -> str | None:
    return None if v is None else _clean(v if isinstance(v, str) else json.dumps(v, ensure_ascii=False))


def _named(v: object) -> tuple[str | None, bool]:
    """Text of a field that holds a text, and whether that is all of it. An object stands for its only text member, if it has just one."""
    if isinstance(v, dict):
        texts = [x for x in v.values() if isinstance(x, str)]
        if len(texts) == 1:
            return _clean(texts[0]), len(v) == 1
    return _text(v), True


# Names of an envelope's two parts.
METADATA, TASK = "metadata", "serialized_task"


def _keys(field: dict, fields: list[dict]) -> list[str]:
    """Names of the members of a field: of an object, or of the records inside a text."""
    if field["type"] == "object":
        return [g["name"] for g in fields if g["parent"] == field["name"]]
    return [k for k, _, _ in (s.rpartition("\x1f") for s in field["shapes"]) if k.startswith("key:")]


def roles(fields: list[dict]) -> tuple[str | None, str | None]:
    """Which top-level fields of a layout are the metadata and the task, told by what they hold and then by name.

    The metadata holds members like those of the task metadata.  The task is
    another field that holds records or bytes, or has its very name.
    """
    tops = [f for f in fields if f["parent"] is None]
    meta, top = None, 0.9
    for f in tops:
        own = [k.removeprefix("key:") for k in _keys(f, fields)]
        score = sum(max((name_similarity(k, m) for k in own), default=0) >= 0.6 for m in METADATA_FIELDS) + 0.5 * name_similarity(f["name"], METADATA)
        if score > top:
            meta, top = f["name"], score
    task, top = None, 0.5
    for f in tops:
        if f["name"] != meta:
            kinds = [k for k, _, _ in (s.rpartition("\x1f") for s in f["shapes"])]
            holds = any(k.startswith("key:") or k in ("record", "bytes") for k in kinds)
            score = 0.5 * holds + 0.6 * name_similarity(f["name"], TASK)
            if score >= top and (task is None or score > top):
                task, top = f["name"], score
    return meta, task


def roles_in_files(layout: DataFrame) -> DataFrame:
    """stream_no, file_no, meta, task (names of the parts in this file), metas, tasks (all names they have in the stream)."""

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            found = [roles([f if isinstance(f, dict) else f.asDict() for f in fs]) for fs in pdf["fields"]]
            yield pd.DataFrame({"stream_no": pdf["stream_no"], "file_no": pdf["file_no"], "meta": [m for m, _ in found], "task": [t for _, t in found]})

    own = written(layout.select("stream_no", "file_no", "fields").mapInPandas(run, "stream_no bigint, file_no int, meta string, task string"), "roles")
    names = own.groupBy("stream_no").agg(F.collect_set("meta").alias("metas"), F.collect_set("task").alias("tasks"))  # distinct names, not files
    return own.join(names, "stream_no")


class _Envelope:
    """One line's envelope; what can't go where it belongs goes to ``extra``, so that nothing is lost."""

    def __init__(self):
        self.meta: dict[str, object] = {}
        self.task: bytes | None = None
        self.extra: dict[str, str | None] = {}

    def keep(self, name: str, path: str, v: object) -> None:
        if v is None:
            return
        name = _clean(name)
        if name in self.extra:  # taken: under its own path, numbered if need be
            name = path = _clean(path)
            n = 2
            while name in self.extra:
                name, n = f"{path}#{n}", n + 1
        self.extra[name] = _text(v)

    def put(self, field: str, path: str, v: object) -> None:
        if v is None:
            return
        if field in self.meta:
            self.keep(path, path, v)
            return
        got, whole = _named(v) if field.startswith("source") else (_millis(v), True)
        if got is None or not whole:
            self.keep(path, path, v)
        if got is not None:
            self.meta[field] = got


def read_envelope(o: dict, names: dict[str, str], meta: str | None, task: str | None, metas: Iterable[str] = (), tasks: Iterable[str] = ()) -> _Envelope:
    """The envelope on a line. names: paths of the file -> first names; meta, task: the file's parts; metas, tasks: names these have elsewhere in the stream."""
    e = _Envelope()
    # a stray line may have the names of another file of the stream
    m = next((k for k in (meta, *metas, METADATA) if k is not None and o.get(k) is not None), None)
    t = next((k for k in (task, *tasks, TASK) if k is not None and k != m and o.get(k) is not None), None)
    for k, v in o.items():
        if k == t:
            e.task = _payload(v)
        elif k != m:
            e.keep(names.get(k, k), k, v)
    if m is not None:
        inner = o[m] if isinstance(o[m], dict) else parse_object(o[m]) if isinstance(o[m], str) else None
        if inner is None:
            e.keep(names.get(m, m), m, o[m])
        else:
            # names in a file's metadata object are recorded under the object's name at that time
            first = {k: names.get(f"{m}.{k}", k).rpartition(".")[2] for k in inner}
            for k in sorted(inner, key=lambda k: (k not in METADATA_FIELDS and f"{m}.{k}" not in names)):  # plain and renamed fields before other spellings
                field = _role(first[k])
                if field is None:
                    e.keep(first[k], f"{m}.{k}", inner[k])
                else:
                    e.put(field, f"{m}.{k}", inner[k])
    return e


def _read(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["stream_no", "file_no", "line_no", *METADATA_FIELDS, "serialized_task", "extra"]
    listed = lambda x: () if x is None else sorted(x)
    for pdf in pdfs:
        rows = []
        for s, f, no, line, first, meta, task, metas, tasks in pdf.itertuples(index=False):
            o = parse_object(line)
            if o is not None:
                e = read_envelope(o, dict(first) if first is not None else {}, meta, task, listed(metas), listed(tasks))
                rows.append((s, f, no, *(e.meta.get(m) for m in METADATA_FIELDS), e.task, e.extra))
        yield pd.DataFrame(rows, columns=names).astype({m: "Int64" for m in ("line_no", "timestamp_millis", "retry_count", "scheduled_time_millis")})


def unified(lines: DataFrame, change: DataFrame, layout: DataFrame, salts: int = 16) -> DataFrame:
    """All parseable lines in one table (``UNIFIED``), whatever layout their file has; ``rejects`` has the others.

    Which fields are the metadata and the task follows from the layouts
    (``roles``).  A field goes under the name it had in the stream's first file,
    spellings of the metadata fields under the field's own name; what is no part
    of an envelope lands in ``extra``.  So does what can't be converted or finds
    its place taken, under its own path: no value is dropped.  Timestamps are
    epoch milliseconds whether they came as numbers, digits or ISO text; the
    task's bytes are the same whether they came as base64, as a list of bytes or
    as an object (then in compact JSON).  Names are joined per file, salted, so
    that one file holding a third of all lines is read by many tasks.  Lines
    without stream or file number are left out.
    """
    lines = lines.select("stream_no", "file_no", "line_no", "line").filter("stream_no is not null and file_no is not null")
    alias = canonical_names(change)
    files = layout.select("stream_no", "file_no")
    per_file = roles_in_files(layout).join(names_in_files(files, alias), ["stream_no", "file_no"], "left")
    per_file = per_file.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = lines.withColumn("salt", F.pmod(F.xxhash64("line_no", "line"), F.lit(salts)).cast("int"))
    joined = salted.join(per_file, ["stream_no", "file_no", "salt"], "left")
    return joined.select("stream_no", "file_no", "line_no", "line", "names", "meta", "task", "metas", "tasks").mapInPandas(_read, UNIFIED)
