"""Schemas that drift between files: one consistent table and a list of every change.

Every file has a schema graph: fields with their names, types, contents and the objects that hold them.  Between a file and the one before
it in its feed, fields of the same path correspond; for what went and what came, match scores are computed by similarity
flooding: a pair of fields starts with the likeness of names, types and contents and then receives a part of the scores of
the pairs of their parents and children, over and over until the scores stand still.  In each object the best consistent
pairs above a threshold are renames.

Scale: lines are profiled as counts of features, which a task adds up for all lines it reads and ``BLOCK`` tasks' sums are
added up next, so a file with a third of all lines is no hot spot; a comparison sees two profiles, whose size depends on
the number of fields and hardly on that of lines.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanwork.session import stage_table

#: Buckets for whole values and for letter groups of a field.
VALUES, GROUPS = 64, 128
#: Least score of a rename, and the share of a neighbour pair's score that a pair receives.
ACCEPT, FLOW = 0.31, 0.25
#: Canonical fields of the consistent table, at most; more is an error, not a cut.
MAX_FIELDS = 2000
#: Feature counts a task holds before it passes them on, and tasks whose sums are added up together.
HELD, BLOCK = 200_000, 256
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def parse(payload: str | None) -> dict | None:
    """The object of a line; null for a line that is cut off or holds none."""
    if not payload:
        return None
    try:
        value = json.loads(payload)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def kind(value: object) -> str | None:
    if value is None:
        return None
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    return "text" if isinstance(value, str) else "list" if isinstance(value, list) else "object"


def _text_features(text: str) -> Iterator[str]:
    yield f"l{(len(text) + 1).bit_length()}"
    for c in "aA0 ":
        if n := sum(map({"a": str.islower, "A": str.isupper, "0": str.isdigit, " ": str.isspace}[c], text)):
            yield from [f"s{c}"] * n
    yield f"v{xxhash.xxh32_intdigest(text) % VALUES}"
    low = f"^{text.lower()}$"
    for i in range(len(low) - 2):
        yield f"g{xxhash.xxh32_intdigest(low[i : i + 3]) % GROUPS}"


def profile(record: dict, path: str = "") -> Iterator[tuple[str, str]]:
    """(path, feature) of every field of a record, inside objects too; a feature comes as often as it occurs."""
    for name, value in record.items():
        at = f"{path}.{name}" if path else name
        yield at, "n"
        k = kind(value)
        if k is None:
            continue
        yield at, f"t{k}"
        if k == "object":
            yield from profile(value, at)
        elif k == "number":
            yield at, f"m{0 if value == 0 else int(math.copysign(1 + math.floor(2 * max(0.0, math.log10(abs(value)) + 6)), value)) if math.isfinite(value) else 999}"
            yield at, "i" if float(value).is_integer() else "f"
        elif k == "boolean":
            yield at, f"b{value}"
        else:
            parts = [value] if k == "text" else [v if isinstance(v, str) else json.dumps(v) for v in value]
            if k == "list":
                yield at, f"c{len(parts).bit_length()}"
            for p in parts:
                for f in _text_features(p):
                    yield at, f


def _cosine(a: dict[str, float], b: dict[str, float], first: str) -> float:
    x = {k: v for k, v in a.items() if k[0] == first}
    y = {k: v for k, v in b.items() if k[0] == first}
    norm = math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
    return sum(v * y.get(k, 0) for k, v in x.items()) / norm if norm else 0.0


def _near(a: dict[str, float], b: dict[str, float], first: str, bins: float = 4) -> float:
    """Likeness of two histograms over ordered bins: one less the distance of their means in units of so many bins."""
    mean = []
    for f in (a, b):
        rows = [(int(k[1:]), v) for k, v in f.items() if k[0] == first]
        if not rows:
            return 0.0
        mean.append(sum(k * v for k, v in rows) / sum(v for _, v in rows))
    return max(0.0, 1 - abs(mean[0] - mean[1]) / bins)


def _parts(name: str) -> list[str]:
    words = [p.lower() for p in _PART.findall(name)]
    return [w[:-3] + "y" if w.endswith("ies") and len(w) > 4 else w[:-1] if w.endswith("s") and len(w) > 2 else w for w in words]


def name_likeness(a: str, b: str) -> float:
    """Share of common parts of two names, in the singular; one part may begin or end the other (op, operation; id, guid)."""
    x, y = _parts(a), _parts(b)

    def near(p: str, q: str) -> bool:
        least, most = sorted((p, q), key=len)
        return p == q or len(least) >= 2 and (most.startswith(least) or most.endswith(least))

    hits = sum(any(near(p, q) for q in y) for p in x) + sum(any(near(p, q) for p in x) for q in y)
    return hits / max(1, len(x) + len(y))


def _identifier(f: dict[str, float]) -> float:
    """How much the content looks like random identifiers: the least share of small letters, capitals and figures, times three."""
    n = sum(v for k, v in f.items() if k[0] == "s")
    return 3 * min(f.get(k, 0) for k in ("sa", "sA", "s0")) / n if n else 0.0


def _main(f: dict[str, float]) -> str | None:
    return max(((v, k[1:]) for k, v in f.items() if k[0] == "t"), default=(0, None))[1]


def likeness(a: str, fa: dict[str, float], b: str, fb: dict[str, float], kids: tuple[set[str], set[str]]) -> float:
    """Start score of a pair of fields from name, type and content."""
    name = name_likeness(a.rpartition(".")[2], b.rpartition(".")[2])
    ta, tb = _main(fa), _main(fb)
    if ta is None or tb is None:  # nothing but nulls on one side: the name alone
        return 0.6 * name
    if ta != tb:
        return 0.35 * name  # a rename keeps the content
    if ta == "boolean":
        return 0.7 * name + 0.15 * _cosine(fa, fb, "b")
    if ta == "number":
        shape = _near(fa, fb, "m", 2) * _cosine(fa, fb, "m") ** 0.5
        whole = 1 - abs(fa.get("i", 0) / (fa.get("i", 0) + fa.get("f", 0)) - fb.get("i", 0) / (fb.get("i", 0) + fb.get("f", 0)))
        content = shape * whole
    elif ta == "object":
        content = len(kids[0] & kids[1]) / max(1, len(kids[0] | kids[1]))
    else:
        content = 0.5 * _cosine(fa, fb, "v") + 0.5 * _cosine(fa, fb, "g") * _near(fa, fb, "l")
        content = max(content, _cosine(fa, fb, "v") ** 2, (_cosine(fa, fb, "g") ** 2) * _near(fa, fb, "l"))
        content = max(content, min(1.0, 2 * min(_identifier(fa), _identifier(fb))) * _cosine(fa, fb, "s") * _near(fa, fb, "l", 1))
        if ta == "list":
            content *= 0.5 + 0.5 * _near(fa, fb, "c")
    return 0.35 * name + 0.65 * content


def flood(before: dict[str, dict[str, float]], after: dict[str, dict[str, float]], rounds: int = 50, tol: float = 1e-4) -> dict[tuple[str, str], float]:
    """Scores of pairs (field that went, field that came) whose objects correspond, after similarity flooding.

    Pairs of the same path correspond with score 1 and pass it on.
    """
    def children(fields: dict, path: str) -> set[str]:
        return {p.rpartition(".")[2] for p in fields if p.rpartition(".")[0] == path}

    gone, come = sorted(set(before) - set(after)), sorted(set(after) - set(before))
    start: dict[tuple[str, str], float] = {}
    for a in gone:
        for b in come:
            if a.count(".") == b.count("."):
                kids = children(before, a), children(after, b)
                start[a, b] = likeness(a, before[a], b, after[b], kids)
    score = dict(start)
    fixed = {(p, p) for p in set(before) & set(after)}
    links: dict[tuple[str, str], list[tuple[str, str]]] = defaultdict(list)
    for a, b in start:
        up = (a.rpartition(".")[0], b.rpartition(".")[0])
        if up in start:
            links[a, b].append(up)
            links[up].append((a, b))
        for c in children(before, a) & children(after, b):  # equal names inside two objects speak for both
            inner = (f"{a}.{c}", f"{b}.{c}")
            if inner in start and inner not in links[a, b]:
                links[a, b].append(inner)
                links[inner].append((a, b))
    for _ in range(rounds):
        new = {p: start[p] + FLOW * (sum(score[q] for q in links[p]) / len(links[p]) if links[p] else start[p]) for p in start}
        top = max(1.0, max(new.values(), default=1.0) / (1 + FLOW))
        new = {p: v / (1 + FLOW) / top for p, v in new.items()}
        worst = max((abs(new[p] - score[p]) for p in new), default=0.0)
        score = new
        if worst < tol:
            break
    return {(a, b): s for (a, b), s in score.items() if a.rpartition(".")[0] == b.rpartition(".")[0] or (a.rpartition(".")[0], b.rpartition(".")[0]) in fixed | set(start)}


def compare(before: dict[str, dict[str, float]], after: dict[str, dict[str, float]], accept: float = ACCEPT) -> list[tuple[str, str, str | None]]:
    """(path, change, path before) of one file against the one before it."""
    score = flood(before, after)
    renamed: dict[str, str] = {}
    used: set[str] = set()
    for s, a, b in sorted(((s, a, b) for (a, b), s in score.items()), key=lambda x: (-x[0], x[1], x[2])):
        if s >= accept and a.rpartition(".")[0] == b.rpartition(".")[0] and a not in used and b not in renamed:
            renamed[b] = a
            used.add(a)
    out = [(b, "renamed", a) for b, a in renamed.items()]
    out += [(b, "added", None) for b in after if b not in before and b not in renamed]
    out += [(a, "removed", a) for a in before if a not in after and a not in used]
    types = lambda f: {k for k in f if k[0] == "t"}
    out += [(p, "retyped", p) for p in after if p in before and types(before[p]) and types(after[p]) and types(before[p]) != types(after[p])]
    whole = {p for p, _, _ in out} | used
    within = lambda p: any(p.startswith(f"{w}.") for w in whole)
    return sorted((p, k, q) for p, k, q in out if not within(p))


@dataclass
class Drift:
    files: DataFrame  # feed, file_id, file_seq, before (file_id of the file before)
    profiles: DataFrame  # feed, file_id, path, block, features (counts as a JSON object)
    changes: DataFrame  # feed, file_id, field_path, change_kind, path_before


def schema_drift(spark: SparkSession, lines: DataFrame, accept: float = ACCEPT) -> Drift:
    """``lines`` has feed, file_id, file_seq and payload (one JSON object).

    Nulls: a line without payload, file or feed is left out, a null value has no type.  Lines that cannot be read count for
    nothing; a file without a readable line is skipped, the next is compared with the last one before it.  Repeated lines
    change nothing.  Files of equal ``file_seq`` follow by ``file_id``.  An empty table has no files and no changes.
    Other columns are ignored.
    """
    source = lines.select("feed", "file_id", "file_seq", "payload").where("feed is not null and file_id is not null and payload is not null")
    fields = ["feed", "file_id", "file_seq"]
    types = [source.schema[n].dataType.simpleString() for n in fields]
    schema = ", ".join(f"{n} {t}" for n, t in zip(fields, types)) + ", path string, block int, features string"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() // BLOCK
        held: dict[tuple, Counter] = defaultdict(Counter)
        new, kinds = 0, None

        def out() -> pa.RecordBatch:
            columns = list(zip(*held)) if held else [()] * 4
            made = [pa.array(c, k) for c, k in zip(columns, [*kinds, pa.string()])]
            made += [pa.array([block] * len(held), pa.int32()), pa.array([json.dumps(c) for c in held.values()], pa.string())]
            return pa.RecordBatch.from_arrays(made, names=[*fields, "path", "block", "features"])

        for batch in batches:
            kinds = [batch.schema.field(n).type for n in fields]
            for key, payload in zip(zip(*(batch.column(n).to_pylist() for n in fields)), batch.column("payload").to_pylist()):
                record = parse(payload)
                if record is None:
                    continue
                held[(*key, "")]["n"] += 1  # the file has a readable line, even an empty object
                for p, f in profile(record):
                    counts = held[(*key, p)]
                    new += f not in counts
                    counts[f] += 1
                if new > HELD:
                    yield out()
                    held.clear()
                    new = 0
        if held:
            yield out()

    def add(group: pa.Table) -> pa.Table:
        sums: dict[str, Counter] = defaultdict(Counter)
        for p, f in zip(group.column("path").to_pylist(), group.column("features").to_pylist()):
            sums[p].update(json.loads(f))
        heads = [group.column(n).take(pa.array([0] * len(sums), pa.int64())) for n in fields]
        tail = [pa.array(list(sums), pa.string()), group.column("block").take(pa.array([0] * len(sums), pa.int64())), pa.array([json.dumps(c) for c in sums.values()], pa.string())]
        return pa.Table.from_arrays([*heads, *tail], names=[*fields, "path", "block", "features"])

    profiles = stage_table(spark, source.mapInArrow(run, schema).groupBy(*fields, "block").applyInArrow(add, schema), "profiles")
    order = Window.partitionBy("feed").orderBy("file_seq", "file_id")
    files = profiles.where("path = ''").groupBy("feed", "file_id").agg(F.min("file_seq").alias("file_seq"))
    files = files.withColumn("before", F.lag("file_id").over(order))
    sides = F.explode(F.array(F.struct(F.col("file_id"), F.lit(True).alias("now")), F.struct(F.col("before").alias("file_id"), F.lit(False).alias("now")))).alias("s")
    sides = files.where("before is not null").select("feed", F.col("file_id").alias("pair"), sides).select("feed", "pair", "s.file_id", "s.now")
    both = sides.join(profiles.select("feed", "file_id", "path", "features"), ["feed", "file_id"])
    feed_type, id_type = types[:2]

    def diff(group: pa.Table) -> pa.Table:
        graphs: dict[bool, dict[str, Counter]] = {True: defaultdict(Counter), False: defaultdict(Counter)}
        for now, path, features in zip(*(group.column(c).to_pylist() for c in ("now", "path", "features"))):
            if path:
                graphs[now][path].update(json.loads(features))
        found = compare(dict(graphs[False]), dict(graphs[True]), accept)
        head = [group.column(c).take(pa.array([0] * len(found), pa.int64())) for c in ("feed", "pair")]
        text = [pa.array([f[k] for f in found], pa.string()) for k in range(3)]
        return pa.Table.from_arrays([*head, *text], names=["feed", "file_id", "field_path", "change_kind", "path_before"])

    out = f"feed {feed_type}, file_id {id_type}, field_path string, change_kind string, path_before string"
    changes = both.groupBy("feed", "pair").applyInArrow(diff, out)
    return Drift(files, profiles, changes)


def canonical_names(spark: SparkSession, drift: Drift) -> dict[str, tuple[str, str]]:
    """path -> (canonical path, type): names that renames connect are one field, under the name most lines have.

    The driver sees one row per path of the whole collection and one per distinct rename, at most ``MAX_FIELDS`` paths.
    """
    kinds_of = ("text", "number", "boolean", "list", "object")
    count = lambda key: F.sum(F.coalesce(F.get_json_object("features", f"$.{key}").cast("long"), F.lit(0)))
    use = drift.profiles.where("path <> ''").groupBy("path").agg(count("n").alias("n"), *[count(f"t{k}").alias(k) for k in kinds_of])
    rows = use.limit(MAX_FIELDS + 1).collect()
    if len(rows) > MAX_FIELDS:
        raise ValueError(f"more than {MAX_FIELDS} fields")
    counts = {r["path"]: r["n"] for r in rows}
    types = {r["path"]: Counter({k: r[k] for k in kinds_of if r[k]}) for r in rows}
    parent = {p: p for p in counts}

    def root(p: str) -> str:
        while parent[p] != p:
            parent[p] = p = parent[parent[p]]
        return p

    for r in drift.changes.where("change_kind = 'renamed'").groupBy("field_path", "path_before").count().where("count > 0").collect():
        parent[root(r["field_path"])] = root(r["path_before"])
    classes: dict[str, list[str]] = defaultdict(list)
    for p in counts:
        classes[root(p)].append(p)
    last: dict[str, str] = {}
    kinds: dict[str, Counter] = defaultdict(Counter)
    for members in classes.values():
        best = max(members, key=lambda p: (counts[p], p))
        for p in members:
            last[p] = best.rpartition(".")[2]
    out = {}
    for p in counts:
        parts = p.split(".")
        out[p] = ".".join(last[".".join(parts[: i + 1])] for i in range(len(parts)))
        kinds[out[p]].update(types[p])
    return {p: (c, next(iter(kinds[c])) if len(kinds[c]) == 1 else "list" if "list" in kinds[c] and "object" not in kinds[c] else "text") for p, c in out.items()}


def consistent_table(spark: SparkSession, lines: DataFrame, drift: Drift) -> DataFrame:
    """One row per readable line (repeated lines once) with every canonical field: text, number, boolean or list of text.

    Fields of objects are columns named by their path with ``_``; a value that does not fit its column's type is null there and
    kept in ``unfit`` as JSON.
    """
    names = canonical_names(spark, drift)
    sql = {"text": "string", "number": "double", "boolean": "boolean", "list": "array<string>"}
    arrow = {"text": pa.string(), "number": pa.float64(), "boolean": pa.bool_(), "list": pa.list_(pa.string())}
    columns: dict[str, str] = {}
    for c, k in sorted({v for v in names.values() if v[1] != "object"}):
        name = c.replace(".", "_")
        while name in columns or name in ("feed", "file_id", "line_no", "unfit"):
            name += "_"
        columns[name] = k
    by_path = {}
    order = iter(columns)
    for c, k in sorted({v for v in names.values() if v[1] != "object"}):
        by_path[c] = (next(order), k)
    keys = ["feed", "file_id", "line_no"]
    schema = ", ".join([*(f"{n} {lines.schema[n].dataType.simpleString()}" for n in keys), *(f"`{n}` {sql[k]}" for n, k in columns.items()), "unfit string"])

    def cast(value: object, want: str) -> object:
        k = kind(value)
        if want == "text":
            return value if k == "text" else json.dumps(value)
        if want == "list":
            return [v if isinstance(v, str) else json.dumps(v) for v in (value if k == "list" else [value])]
        if want == "number":
            return float(value) if k == "number" else None
        return value if k == want else None

    def flat(record: dict, path: str = "") -> Iterator[tuple[str, object]]:
        for name, value in record.items():
            at = f"{path}.{name}" if path else name
            to, want = names[at]
            if isinstance(value, dict) and want == "object":
                yield from flat(value, at)
            elif value is not None:
                yield to, value

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, values, unfit = [], {n: [] for n in columns}, []
            for i, payload in enumerate(batch.column("payload").to_pylist()):
                record = parse(payload)
                if record is None:
                    continue
                rows.append(i)
                row, rest = {}, {}
                for to, value in flat(record):
                    name, want = by_path.get(to, (None, None))
                    fit = cast(value, want) if name else None
                    if fit is None or name in row:
                        rest[to] = value
                    else:
                        row[name] = fit
                for n in columns:
                    values[n].append(row.get(n))
                unfit.append(json.dumps(rest) if rest else None)
            kept = batch.select(keys).take(pa.array(rows, pa.int32()))
            made = [pa.array(values[n], arrow[k]) for n, k in columns.items()] + [pa.array(unfit, pa.string())]
            yield pa.RecordBatch.from_arrays([*kept.columns, *made], names=[*keys, *columns, "unfit"])

    source = lines.select(*keys, "payload").where("feed is not null and file_id is not null and payload is not null").distinct()
    return source.mapInArrow(run, schema)
