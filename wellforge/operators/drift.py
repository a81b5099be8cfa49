"""Schemas that drift between files: minimum-cost edit scripts between consecutive schemas, and one consistent table."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wellforge.session import cut, stored
from wellforge.sources.feature_files import MISSING, NUMBER, series_name

# ---------------------------------------------------------------- schema trees and their edit distance


@dataclass(frozen=True)
class Node:
    """A field of a schema: name, type name, and the fields below it (empty for a leaf)."""

    name: str
    kind: str = ""
    children: tuple[Node, ...] = field(default=())


def tree_of(schema: T.StructType, name: str = "") -> Node:
    """The tree of a Spark schema; arrays and maps are descended into through their element and value types."""

    def node(label: str, kind: T.DataType) -> Node:
        if isinstance(kind, T.StructType):
            return Node(label, "struct", tuple(node(f.name, f.dataType) for f in kind.fields))
        if isinstance(kind, T.ArrayType):
            return Node(label, "array", node("element", kind.elementType).children)
        if isinstance(kind, T.MapType):
            return Node(label, "map", node("value", kind.valueType).children)
        return Node(label, kind.simpleString())

    return node(name, schema)


def _size(n: Node) -> int:
    return 1 + sum(map(_size, n.children))


def assign(cost: list[list[float]]) -> list[int]:
    """Columns assigned to the rows of a square cost matrix at the least total cost (shortest augmenting paths, O(n^3))."""
    n = len(cost)
    row_price, col_price, row_of = [0.0] * (n + 1), [0.0] * (n + 1), [0] * (n + 1)
    for r in range(1, n + 1):
        row_of[0], here = r, 0
        slack, came, done = [math.inf] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        while row_of[here]:
            done[here] = True
            at, step, nxt = row_of[here], math.inf, 0
            for c in range(1, n + 1):
                if not done[c]:
                    reduced = cost[at - 1][c - 1] - row_price[at] - col_price[c]
                    if reduced < slack[c]:
                        slack[c], came[c] = reduced, here
                    if slack[c] < step:
                        step, nxt = slack[c], c
            for c in range(n + 1):
                if done[c]:
                    row_price[row_of[c]] += step
                    col_price[c] -= step
                else:
                    slack[c] -= step
            here = nxt
        while here:
            row_of[here], here = row_of[came[here]], came[here]
    out = [0] * n
    for c in range(1, n + 1):
        out[row_of[c] - 1] = c - 1
    return out


def edit_script(old: Node, new: Node, rename_cost) -> tuple[float, list[tuple[str, str, str]]]:
    """The least-cost script between two unordered schema trees: (cost, [(operation, old path, new path)]).

    Adding or deleting a field costs one for each field of its subtree. `rename_cost(a, b)` gives the cost of turning the field
    `a` into `b`, 0 for fields that are the same; two or more never beats a deletion with an addition. The children of a pair of
    fields are matched by a minimum-cost assignment, recursively. A field deleted in one place and added with the same name
    and type under another parent is a move. Operations: add, delete, rename, retype, move. The order of siblings is no change.
    """

    def match(a: Node, b: Node, pa: str, pb: str) -> tuple[float, list]:
        same = {x.name: x for x in b.children}
        pairs = [(x, same[x.name]) for x in a.children if x.name in same]
        kept = {x.name for x, _ in pairs}
        left, right = [x for x in a.children if x.name not in kept], [x for x in b.children if x.name not in kept]
        total, script = 0.0, []
        for x, y in pairs:
            total += visit(x, y, pa, pb, 0.0, script)
        n, m = len(left), len(right)
        if n and m:
            inner = [[match(x, y, pa + x.name + "/", pb + y.name + "/") for y in right] for x in left]
            cost = [[rename_cost(x, y) + inner[i][j][0] for j, y in enumerate(right)] + [float(_size(x)) if k == i else math.inf for k in range(n)] for i, x in enumerate(left)]
            cost += [[float(_size(y)) if k == j else math.inf for j, y in enumerate(right)] + [0.0] * n for k in range(m)]
            chosen = assign([[min(c, 1e9) for c in row] for row in cost])
            gone = set(range(m))
            for i, j in enumerate(chosen[:n]):
                if j < m:
                    gone.discard(j)
                    total += visit(left[i], right[j], pa, pb, rename_cost(left[i], right[j]), script)
                else:
                    total += _size(left[i])
                    script.append(("delete", pa + left[i].name, "", left[i]))
            rest = [right[j] for j in sorted(gone)]
        else:
            rest = right
            for x in left:
                total += _size(x)
                script.append(("delete", pa + x.name, "", x))
        for y in rest:
            total += _size(y)
            script.append(("add", "", pb + y.name, y))
        return total, script

    def visit(x: Node, y: Node, pa: str, pb: str, cost: float, script: list) -> float:
        if x.name != y.name:
            script.append(("rename", pa + x.name, pb + y.name, y))
        if x.kind and y.kind and x.kind != y.kind:
            script.append(("retype", pa + x.name, pb + y.name, y))
        below, more = match(x, y, pa + x.name + "/", pb + y.name + "/")
        script += more
        return cost + below

    total, script = match(old, new, "", "")
    added = {(s[3].name, s[3].kind, s[3].children): s for s in script if s[0] == "add"}
    out = []
    for op, a, b, node in script:
        key = (node.name, node.kind, node.children)
        if op == "delete" and key in added:
            total -= 2 * _size(node) - 1
            out.append(("move", a, added.pop(key)[2]))
        else:
            out.append((op, a, b, node))
    moved = {x[2] for x in out if x[0] == "move"}
    return total, [x[:3] for x in out if not (x[0] == "add" and x[2] in moved)]


# ---------------------------------------------------------------- names and values of columns

def name_tokens(name: str) -> tuple[str, ...]:
    """Lower-case words of a column name; case changes, digits and signs divide, and numbers have no leading zeros."""
    words = re.findall(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+[a-z]{2}(?![a-z])|[0-9]+", name)
    return tuple(w.lstrip("0") or "0" if w.isdigit() else w.lower() for w in words)


def name_key(name: str) -> str:
    return "".join(name_tokens(name))


#: Fixed patterns: a number with a mark before it or a unit behind it, and the digits after its point.
CORE = r"^[#~<>=]?\s*(?P<x>[+-]?[0-9]+(?:[.,][0-9]+)?(?:[eE][+-]?[0-9]+)?)\s*(?:%|[A-Za-zµ°/]+)?$"
FRACTION = r"[.,](?P<f>[0-9]+)$"
PROFILE = 7


def value_profiles(columns: pa.ListArray, content: pa.Array) -> tuple[list[str | None], np.ndarray]:
    """The kind and the profile of each column of each file, file after file.

    Kind: 'integer', 'decimal' or 'text' of the values that are not missing; None if all are missing. Profile, over the same
    values: count; of numbers, with or without a unit, their count, sum, sum of squares and digits after the point; of other texts
    the sum of lengths and how many hold a digit. All values of the batch are looked at together.
    """
    width = pc.fill_null(pc.list_value_length(columns), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(width)])
    text = pc.replace_with_mask(content, pc.equal(content, ""), pa.scalar(None, content.type))
    lines = pc.split_pattern(text, "\n")
    file_of = np.repeat(np.arange(len(content)), pc.fill_null(pc.list_value_length(lines), 0).to_numpy(zero_copy_only=False))
    cells = pc.split_pattern(lines.flatten(), "\t")
    many = pc.list_value_length(cells).to_numpy(zero_copy_only=False).astype(np.int64)
    file_of, place = np.repeat(file_of, many), np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    values = cells.flatten()
    counts = (place < width[file_of]) & ~pc.is_in(values, pa.array(MISSING, values.type)).to_numpy(zero_copy_only=False)
    values, at = values.filter(pa.array(counts)), (first[file_of] + place)[counts]
    flag = lambda x: pc.fill_null(x, False).to_numpy(zero_copy_only=False)
    number, point = flag(pc.match_substring_regex(values, NUMBER)), flag(pc.match_substring_regex(values, "[.eE]"))
    core = pc.struct_field(pc.extract_regex(values, CORE), "x")
    x = pc.cast(pc.replace_substring(core, ",", "."), pa.float64()).to_numpy(zero_copy_only=False)
    some = flag(pc.is_valid(core))
    counted = some & np.isfinite(x) & (np.abs(np.where(some, x, 0.0)) < 1e150)
    x = np.where(counted, x, 0.0)
    digits = pc.fill_null(pc.utf8_length(pc.utf8_rtrim(pc.struct_field(pc.extract_regex(core, FRACTION), "f"), "0")), 0).to_numpy(zero_copy_only=False)
    length, mixed = pc.utf8_length(values).to_numpy(zero_copy_only=False), flag(pc.match_substring_regex(values, "[0-9]"))
    total = lambda w: np.bincount(at, w, minlength=first[-1])
    sums = [np.ones(len(x)), counted, x, x * x, np.where(counted, digits, 0), np.where(some, 0, length), mixed & ~some]
    profiles = np.stack([total(w.astype(float)) for w in sums], 1) if first[-1] else np.zeros((0, PROFILE))
    texts, decimals, seen = total(~number * 1.0), total((number & point) * 1.0), profiles[:, 0]
    kinds = [None if not n else "text" if t else "decimal" if d else "integer" for n, t, d in zip(seen, texts, decimals)]
    return kinds, profiles


def value_kind(values: Iterable[str]) -> str | None:
    """The kind of one column's values."""
    return value_profiles(pa.array([["c"]]), pa.array(["\n".join(values)], pa.string()))[0][0]


FILE_SCHEMA = T.StructType(
    [
        T.StructField("file_id", T.LongType()),
        T.StructField("series", T.StringType()),
        T.StructField("written_at", T.TimestampNTZType()),
        T.StructField("names", T.ArrayType(T.StringType())),
        T.StructField("kinds", T.ArrayType(T.StringType())),
        T.StructField("profiles", T.ArrayType(T.ArrayType(T.DoubleType()))),
    ]
)


def file_schemas(files: DataFrame) -> DataFrame:
    """One narrow row per file: its columns, the kinds of their values and summaries of those values.

    Null columns give an empty schema; null or empty content gives kinds of null; short lines are filled with missing values.
    """
    needed = files.select("file_id", series_name(F.col("name"), F.col("Path")).alias("series"), F.col("written_at").cast("timestamp_ntz").alias("written_at"), "columns", "content")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = b.column("columns")
            kinds, profiles = value_profiles(columns, b.column("content"))
            width = pc.fill_null(pc.list_value_length(columns), 0).to_numpy(zero_copy_only=False)
            ends = pa.array(np.concatenate([[0], np.cumsum(width)]), pa.int32())
            each = pa.array(np.arange(0, PROFILE * (len(profiles) + 1), PROFILE), pa.int32())
            names = pa.ListArray.from_arrays(ends, pc.fill_null(columns.flatten(), ""))
            profiles = pa.ListArray.from_arrays(ends, pa.ListArray.from_arrays(each, pa.array(profiles.ravel())))
            kept = [b.column(c) for c in ("file_id", "series", "written_at")]
            yield pa.RecordBatch.from_arrays([*kept, names, pa.ListArray.from_arrays(ends, pa.array(kinds, pa.string())), profiles], FILE_SCHEMA.names)

    return needed.mapInArrow(parse, FILE_SCHEMA)


@dataclass(frozen=True)
class NameModel:
    """What the whole collection says of column names: value profiles by name, and which names replace which."""

    profiles: dict[str, tuple[float, ...]]
    together: dict[tuple[str, str], int]
    added: dict[str, int]

    def values_apart(self, a: str, b: str) -> float:
        """0 for equal distributions of values, up to 1.5 for unlike ones; 0.5 where one side has no values."""
        p, q = self.profiles.get(a), self.profiles.get(b)
        if not p or not q or not p[0] or not q[0]:
            return 0.5
        if (p[1] > 0.5 * p[0]) != (q[1] > 0.5 * q[0]):
            return 1.5
        if p[1] <= 0.5 * p[0]:
            (a1, d1), (a2, d2) = ((x[5] / max(1.0, x[0] - x[1]), x[6] / max(1.0, x[0] - x[1])) for x in (p, q))
            return min(1.5, 0.25 + abs(a1 - a2) / 3 + 1.5 * abs(d1 - d2))
        (m, s), (n, t) = ((x[2] / x[1], max(x[3] / x[1] - (x[2] / x[1]) ** 2, 1e-12 + 1e-6 * (x[2] / x[1]) ** 2)) for x in (p, q))
        # a handful of values says little of its own spread
        s, t = (p[1] * s + 4 * t) / (p[1] + 4), (q[1] * t + 4 * s) / (q[1] + 4)
        apart = 0.25 * math.log(0.25 * (s / t + t / s + 2)) + 0.25 * (m - n) ** 2 / (s + t)
        return min(1.5, 2.5 * apart + 0.15 * min(3.0, abs(p[4] / p[1] - q[4] / q[1])))

    def rename_cost(self, x: Node, y: Node) -> float:
        """The cost of taking column `y` for column `x` under another name; from 2 on they are held to be unlike."""
        a, b = name_key(x.name), name_key(y.name)
        if a == b:
            return 0.0
        s, t = name_tokens(x.name), name_tokens(y.name)
        common = sum(min(s.count(w), t.count(w)) for w in set(s))
        unlike = 1 - common / max(len(s), len(t))
        support = self.together.get((a, b), 0)
        usual = support / max(self.added.get(b, 0), support + 1)
        return 0.3 + 0.9 * unlike + 1.4 * self.values_apart(a, b) - 1.0 * usual


CHANGES = T.StructType(
    [
        T.StructField("file_id", T.LongType()),
        T.StructField("change", T.StringType()),
        T.StructField("old_field", T.StringType()),
        T.StructField("new_field", T.StringType()),
    ]
)
_SCAN = T.StructType([*CHANGES.fields, T.StructField("pid", T.IntegerType()), T.StructField("inherits", T.StringType()), T.StructField("kind", T.StringType())])


def _steps(files: pd.DataFrame, before: tuple | None) -> Iterator[tuple]:
    """(series, file_id, old names or None, names, kinds) for the sorted rows of one partition."""
    series, old = (before[0], before[1]) if before else (None, None)
    for r in files.itertuples(index=False):
        names = [] if r.names is None else list(r.names)
        yield r.series, r.file_id, (old if before is not None and r.series == series else None), names, ([] if r.kinds is None else list(r.kinds))
        series, old, before = r.series, names, before or ("",)


def schema_changes(files: DataFrame) -> DataFrame:
    """Every change of columns of each file against the file before it in its series: (file_id, change, old_field, new_field).

    Files follow one another by written_at, file_id within their series. The schemas of neighbours are compared by tree edit
    distance; the cost of a rename comes from the words of both names, from the values under both names over the whole
    collection, and from how often the one replaces the other. The fields of the older tree have the kind of the last file in
    which the column had values, since it was last added, under whatever name, so that the script's retype is the change of type;
    its old_field is the name in the file before.

    Scale: only one narrow row per file is shuffled, range-partitioned by (series, time), so that a series with a third of all
    files is spread over many tasks. Each task scans its sorted range once; what it must know of the ranges before it, the last
    schema and the last kinds of its columns, is a few rows a partition and is put in by the driver. A first file of a series,
    files without columns, null timestamps (first) and repeated column names (the last counts) give no error.
    """
    spark = files.sparkSession
    per_file = stored(file_schemas(files), "file_schemas")  # the ranges are sampled before they are made: two scans
    order = ["series", F.col("written_at").asc_nulls_first(), "file_id"]
    parts = cut(per_file.repartitionByRange(*order).sortWithinPartitions(*order))

    pid = F.spark_partition_id()
    last = parts.groupBy(pid.alias("pid")).agg(
        F.max_by(F.struct("series", "names"), F.struct(F.coalesce("series", F.lit("")), F.coalesce("written_at", F.lit("0001-01-01").cast("timestamp_ntz")), "file_id")).alias("z")
    )
    ends = {r["pid"]: (r["z"]["series"], list(r["z"]["names"] or [])) for r in last.collect()}
    before = {p: ends[max(q for q in ends if q < p)] for p in ends if any(q < p for q in ends)}

    model = _name_model(parts, before)
    found = cut(parts.select("series", "file_id", "names", "kinds").mapInPandas(_scanner(before, model), _SCAN))

    # the kinds at the end of each range, in the order of the ranges: a few rows each
    state: dict[int, dict[str, str | None]] = {}
    rows: dict[int, list] = {}
    for r in found.filter("change = '~end'").select("pid", "old_field", "inherits", "kind").collect():
        rows.setdefault(r["pid"], []).append(r)
    carried: dict[str, str | None] = {}
    start: list[tuple[int, str, str | None]] = []
    for p in sorted(ends):
        start += [(p, n, k) for n, k in carried.items()]
        carried = {r["old_field"]: (carried.get(r["inherits"]) if r["inherits"] is not None else r["kind"]) for r in rows.get(p, [])}
        state[p] = carried
    known = spark.createDataFrame(start, "pid int, inherits string, was string")
    open_ = found.filter("change = '~open'").join(F.broadcast(known), ["pid", "inherits"])
    late = open_.filter(F.col("was").isNotNull() & (F.col("was") != F.col("kind"))).select("file_id", F.lit("retyped").alias("change"), "old_field", "new_field")
    return found.filter(~F.col("change").startswith("~")).select("file_id", "change", "old_field", "new_field").unionByName(late)


def _pairs(old: list[str], new: list[str]) -> tuple[list[str], list[str]]:
    return [c for c in dict.fromkeys(old) if c not in set(new)], [c for c in dict.fromkeys(new) if c not in set(old)]


def _name_model(parts: DataFrame, before: dict[int, tuple]) -> NameModel:
    """Profiles and replacement counts over all files. Its size follows the number of different names, not of files."""

    def events(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[tuple[str, str], list[float]] = {}
        old = before.get(TaskContext.get().partitionId())
        for part in batches:
            for names, profiles in zip(part["names"], part["profiles"]):
                for c, p in zip(names, profiles):
                    sums = counts.setdefault(("", name_key(c)), [0.0] * PROFILE)
                    for i in range(PROFILE):
                        sums[i] += p[i]
            for series, _, last, new, _ in _steps(part, old):
                old = (series, new)
                if last is not None:
                    gone, come = _pairs(last, new)
                    for b in come:
                        counts.setdefault(("+", name_key(b)), [0.0] * PROFILE)[0] += 1
                        for a in gone:
                            counts.setdefault((name_key(a) + "\x01", name_key(b)), [0.0] * PROFILE)[0] += 1
        yield pd.DataFrame([(a, b, v) for (a, b), v in counts.items()], columns=["a", "b", "v"])

    sums = parts.select("series", "file_id", "names", "kinds", "profiles").mapInPandas(events, "a string, b string, v array<double>")
    rows = sums.groupBy("a", "b").agg(*(F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(PROFILE))).collect()
    profiles, together, added = {}, {}, {}
    for r in rows:
        if r["a"] == "":
            profiles[r["b"]] = tuple(r[f"v{i}"] for i in range(PROFILE))
        elif r["a"] == "+":
            added[r["b"]] = int(r["v0"])
        else:
            together[r["a"][:-1], r["b"]] = int(r["v0"])
    return NameModel(profiles, together, added)


#: The operations of a script in the words of the report.
CHANGE = {"add": "added", "delete": "removed", "rename": "renamed", "retype": "retyped"}


def _scanner(before: dict[int, tuple], model: NameModel):
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pid, out = TaskContext.get().partitionId(), []
        known: dict[str, tuple[str, str | None]] = {}  # column -> ('kind', its last kind) or ('open', its name before this range)
        series_now: object = None
        begin = before.get(pid)
        if begin:
            series_now, known = begin[0], {c: ("open", c) for c in begin[1]}
        old = begin
        for b in batches:
            for series, fid, names_old, names, kinds in _steps(b, old):
                old = (series, names)
                if names_old is None or series != series_now:
                    series_now = series
                    known = {c: ("kind", k) for c, k in zip(names, kinds)}
                    continue
                last, own = {c: known.get(c, ("kind", None)) for c in names_old}, dict(zip(names, kinds))
                source = {c: c for c in own if c in last}
                if own.keys() != last.keys() or any(last[c][1] != k or last[c][0] == "open" for c, k in own.items() if k):
                    # a kind from before this range is not known yet: such a column is compared later
                    trees = [Node("", "", tuple(Node(c, k or "") for c, k in side)) for side in (((c, v if how == "kind" else "") for c, (how, v) in last.items()), own.items())]
                    for op, a, c in edit_script(*trees, model.rename_cost)[1]:
                        if op == "rename":
                            source[c] = a
                        out.append((fid, CHANGE[op], a, c, pid, None, None))
                now = {}
                for c, k in own.items():
                    was = source.get(c)
                    how, value = last[was] if was is not None else ("kind", None)
                    if k is not None and how == "open":
                        out.append((fid, "~open", was, c, pid, value, k))
                    now[c] = (how, value) if k is None else ("kind", k)
                known = now
            if len(out) > 50_000:
                yield pd.DataFrame(out, columns=[f.name for f in _SCAN.fields])
                out = []
        for c, (how, value) in known.items():
            out.append((None, "~end", c, None, pid, value if how == "open" else None, value if how == "kind" else None))
        frame = pd.DataFrame(out, columns=[f.name for f in _SCAN.fields])
        frame["file_id"] = frame["file_id"].astype("Int64")
        yield frame

    return scan


# ---------------------------------------------------------------- one consistent table


def _joined_names(links: Iterable[tuple[str, str, int]], together: Iterable[Iterable[str]]) -> dict[str, set[str]]:
    """Groups of names joined by renames, the most frequent first; names that stand together in one file are never joined."""
    apart: dict[str, set[str]] = {}
    for names in map(set, together):
        for c in names:
            apart.setdefault(c, set()).update(names - {c})
    group = {c: {c} for c in apart}
    for a, b, _ in sorted(links, key=lambda r: (-r[2], r[0], r[1])):
        x, y = group.setdefault(a, {a}), group.setdefault(b, {b})
        if x is not y and not any(apart.get(c, set()) & y for c in x):
            x |= y
            group.update(dict.fromkeys(y, x))
    return group


def quantity_map(changes: DataFrame, files: DataFrame) -> DataFrame:
    """(series, name, quantity, apart): what each column name measures in the files of a series.

    Names are joined by the renames of their own series. Groups of several series share a quantity where the renames of all
    files, the most frequent first, join their usual names. Names that stand together in one file are never joined, so every
    column of a file has a quantity of its own; `apart` marks the names for which a rename was not followed because of that.

    The names of a collection are few whatever its number of files; only they, their sets and their renames are gathered. The
    names of one series are one group, whose rows are its different sets of columns.
    """
    spark = files.sparkSession
    sets = files.select("file_id", series_name(F.col("name"), F.col("Path")).alias("series"), F.array_sort(F.array_distinct(F.transform("columns", lambda c: F.coalesce(c, F.lit(""))))).alias("names"))
    sets = sets.filter("names IS NOT NULL")
    by_series = stored(sets.groupBy("series", "names").agg(F.count("*").alias("n")), "column_sets")
    renames = changes.filter("change = 'renamed'").join(sets.select("file_id", "series"), "file_id").groupBy("series", "old_field", "new_field").agg(F.count("*").alias("n"))
    renames = stored(renames, "renames")
    every = by_series.groupBy("names").agg(F.sum("n").alias("n")).collect()
    seen: dict[str, int] = {}
    for r in every:
        for c in r["names"]:
            seen[c] = seen.get(c, 0) + r["n"]
    links = [(r["old_field"], r["new_field"], r["n"]) for r in renames.groupBy("old_field", "new_field").agg(F.sum("n").alias("n")).collect()]

    def first(names: Iterable[str]) -> str:
        return min(names, key=lambda c: (-seen.get(c, 0), c))

    spelling: dict[str, str] = {}  # column names of Spark differ by more than case
    for c in sorted(seen, key=lambda c: (-seen[c], c)):
        spelling.setdefault(c.lower(), c)
    usual = {c: first(g) for c, g in _joined_names(links, [r["names"] for r in every]).items()}

    def of_series(rows: pd.DataFrame) -> pd.DataFrame:
        together = [list(x) for x in rows.loc[rows["names"].notna(), "names"]]
        here = [(r.old_field, r.new_field, r.n) for r in rows[rows["names"].isna()].itertuples()]
        group = _joined_names(here, together)
        refused = {c for a, b, _ in here if group[a] is not group[b] for c in (a, b)}
        taken: dict[str, list[set[str]]] = {}
        out = []
        for g in sorted({id(g): g for g in group.values()}.values(), key=lambda g: (-seen.get(first(g), 0), first(g))):
            beside = {c for names in together if g & set(names) for c in names} - g
            own = sorted(g, key=lambda c: (-seen.get(c, 0), c))
            for k in range(len(own) + 2 + len(group)):
                q = [usual.get(own[0], own[0]), *own][k] if k <= len(own) else f"{own[0]} ({k - len(own) + 1})"
                q = spelling.get(q.lower(), q)
                if not any(beside & other for other in taken.get(q.lower(), [])):
                    break
            taken.setdefault(q.lower(), []).append(g)
            out += [(rows["series"].iloc[0], c, q, c in refused) for c in own]
        return pd.DataFrame(out, columns=["series", "name", "quantity", "apart"])

    none = F.lit(None)
    rows = by_series.select("series", "names", none.cast("string").alias("old_field"), none.cast("string").alias("new_field"), "n").unionByName(renames.withColumn("names", none.cast("array<string>")))
    return stored(rows.groupBy("series").applyInPandas(of_series, "series string, name string, quantity string, apart boolean"), "quantities")


def widest_types(table: DataFrame, keys: Iterable[str] = ("file_id", "series", "label")) -> DataFrame:
    """The table with every text column in the widest type of its values: bigint, double or string. One aggregation of the rows.

    A column whose values are all whole numbers is bigint, one of numbers double, any other stays text; so does one without values.
    """
    columns = [c for c in table.columns if c not in set(keys)]
    quoted = {c: F.col("`" + c.replace("`", "``") + "`") for c in columns}
    if not columns:
        return table
    tests = {"n": lambda x: x.isNotNull(), "w": lambda x: x.rlike(r"^[+-]?[0-9]{1,18}$"), "d": lambda x: x.rlike(NUMBER)}
    found = table.agg(*(F.count_if(t(quoted[c])).alias(f"{k}{i}") for i, c in enumerate(columns) for k, t in tests.items())).first()
    cast = {c: "bigint" if found[f"w{i}"] == found[f"n{i}"] else "double" for i, c in enumerate(columns) if found[f"n{i}"] and found[f"d{i}"] == found[f"n{i}"]}
    return table.select(*(quoted[c].try_cast(cast[c]).alias(c) if c in cast else F.col("`" + c.replace("`", "``") + "`") for c in table.columns))


def unified_table(files: DataFrame, quantities: DataFrame) -> DataFrame:
    """All records of all files under one schema: file_id, series, label, and one text column per quantity (null: missing).

    The records of a series are projected by the names of that series, row by row in the JVM. A name that a file holds twice
    counts once, with its last value. `widest_types` gives the columns their types.
    """
    from wellforge.sources.feature_files import feature_records

    lookup = quantities.groupBy(F.col("series").alias("_series")).agg(F.map_from_entries(F.collect_list(F.struct("name", "quantity"))).alias("_lookup"))
    records = feature_records(files)
    records = records.join(lookup, records["series"].eqNullSafe(lookup["_series"]), "left")
    cells = F.filter(
        F.transform(F.arrays_zip(F.col("columns").alias("c"), F.split("line", "\t").alias("v")), lambda x: F.struct(F.coalesce(F.try_element_at(F.col("_lookup"), F.coalesce(x["c"], F.lit(""))), x["c"], F.lit("")).alias("q"), x["v"].alias("v"))),
        lambda x: x["v"].isNotNull() & ~x["v"].isin(*MISSING),
    )
    values = records.select("file_id", "series", "label", cells.alias("cells"))

    def value(q: str) -> Column:
        return F.try_element_at(F.filter("cells", lambda x: x["q"] == q), F.lit(-1))["v"].alias(q)

    return values.select("file_id", "series", "label", *(value(q) for q in sorted(r["quantity"] for r in quantities.select("quantity").distinct().collect())))
