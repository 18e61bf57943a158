"""Deeply nested records to related flat tables (structural-variant tables).

A bottom-up tree automaton gives every JSON node a state: a leaf by its type, a list by its members' states, an object by its map of
labels to child states. So producers' layouts that differ in wrappers, key order, optional fields or encoding reach the same
state; transitions are remembered by shape. A top-down pass then routes each list of child objects by its state and the label it
stands under: spans become word rows, text boxes box rows. Each object's subtype is decided by the states of its fields, and
``subtype_tables`` gives one typed table per subtype; all of them keep the common supertype keys (record_id, parent_pos, child_pos),
by which they join their parent in ``parent_table``, and the name of the variant, the sorted labels the object really had.

Lists of objects under any other label are lost to no one: ``object_table`` has a row for each object of any list of a record, with its
place, its parent's place and its fields.

Defined results
  * null or invalid payload: no rows. Only strict JSON counts: NaN and Infinity are invalid.
  * a container stored as a JSON string is decoded; a single object in place of a list is a list of one; an object
    whose labels are all whole numbers is a list in the order of these numbers; a plain string in place of a word
    or box object is its text.
  * null and blank children keep their place. They come out as rows only with ``keep_blank``.
  * repeated records give their rows once.
  * numbers as strings are read as numbers; other types become null.
  * object_table: the fields that aren't lists of objects, as text; nested objects outside lists belong to the object around them,
    their labels joined by dots. The root of a record is no row of it.
  * extra columns of the input, also of clashing names, are never read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: States of the automaton. A SPAN is the common supertype of words and segments, a PANEL that of boxes.
NULL, SCALAR, NUMBER, TEXT, NUMBERS, POLYGON, SPAN, PANEL, SEGMENT, EVENT, SEGMENTS, EVENTS, SPANS, PANELS, WRAPPER, OTHER = range(16)
_LEAF = {type(None): NULL, bool: SCALAR, int: NUMBER, float: NUMBER, str: TEXT}
_MANY = {SEGMENT: SEGMENTS, EVENT: EVENTS, WRAPPER: WRAPPER, SPAN: SPANS, PANEL: PANELS}
_NUMERIC = frozenset((NUMBER, TEXT, NULL))

TEXT_LABELS = ("word", "text")
CHILD_LABELS = {"words": "word", "boxes": "box"}
LIST_LABELS = {"segments": SEGMENT, "events": EVENT, "ocr_events": EVENT}
EVENT_LABELS = frozenset(("boxes", "ocr", "frame_index", "timestamp"))
SPAN_LABELS = frozenset(("start", "end", "word"))
PANEL_LABELS = frozenset(("bbox", "poly", "x1", "confidence"))

CHILD_SCHEMA = (
    "record_id bigint, child_kind string, parent_pos int, child_pos int, subtype string, variant string, text string, start double, end double, "
    "score double, x1 int, y1 int, x2 int, y2 int"
)
PARENT_SCHEMA = "record_id bigint, parent_kind string, parent_pos int, variant string, text string, start double, end double, frame_index bigint, n_children int"


def _strict(name: str) -> None:
    raise ValueError(name)


def decode(value: str):
    """A JSON container out of a string, else the string itself."""
    if value[:1] in ("[", "{"):
        try:
            return json.loads(value, parse_constant=_strict)
        except (ValueError, RecursionError):
            return value
    return value


def items(value) -> list:
    """The children of a container node in their order."""
    if isinstance(value, str):
        value = decode(value)
        if isinstance(value, str):
            return [value] if value.strip() else []
    if isinstance(value, list):
        return value
    if isinstance(value, dict):
        if value and all(k.isdecimal() for k in value):
            return [value[k] for k in sorted(value, key=int)]
        return [value] if value else []
    return []


class TreeAutomaton:
    """State of a node from its labels and its children's states; object transitions are remembered by shape."""

    def __init__(self) -> None:
        self.transitions: dict[tuple, tuple[int, str]] = {}
        #: Of objects that hold leaves alone, by labels and types: the result, and the labels whose strings could hold containers.
        self.flat: dict[tuple, tuple[tuple[int, str], tuple[str, ...]]] = {}
        self.start_record()

    def start_record(self) -> None:
        """Forget the nodes of the record before; transitions stay."""
        self.decoded: dict[str, object] = {}
        self.seen: dict[int, tuple[object, tuple[int, str]]] = {}

    def decode(self, value: str):
        """decode() once per string, so that what it holds keeps its state."""
        if value[:1] not in ("[", "{"):
            return value
        if value not in self.decoded:
            self.decoded[value] = decode(value)
        return self.decoded[value]

    def state(self, node) -> int:
        return self.classify(node)[0]

    def subtype(self, node) -> str:
        return self.classify(node)[1]

    def classify(self, node) -> tuple[int, str]:
        """(state, subtype); only spans and panels have a subtype, and a plain string is the bare one of both."""
        if isinstance(node, str):
            node = self.decode(node)
        leaf = _LEAF.get(type(node))
        if leaf is not None:
            return leaf, "bare"
        if isinstance(node, dict):
            flat = self.flat.get((tuple(node), tuple(map(type, node.values()))))
            if flat is not None and not any(node[k][:1] in ("[", "{") for k in flat[1]):
                return flat[0]
        known = self.seen.get(id(node))
        if known is not None:
            return known[1]
        if isinstance(node, list):
            result = self.of_list({self.state(x) for x in node}), ""
        elif node and all(k.isdecimal() for k in node):
            result = self.of_list({self.state(x) for x in node.values()}), ""
        else:
            shape = []
            for label, value in node.items():
                leaf = _LEAF.get(type(value))
                if leaf is None or (leaf == TEXT and label not in TEXT_LABELS and value[:1] in ("[", "{")):
                    leaf = self.classify(value)[0]
                shape.append((label, leaf))
            key = tuple(shape)
            if (result := self.transitions.get(key)) is None:
                result = self.transitions[key] = self.of_object(dict(shape))
            types = tuple(map(type, node.values()))
            texts = tuple(k for k, v in node.items() if type(v) is str and k not in TEXT_LABELS)
            if all(t in _LEAF for t in types) and not any(node[k][:1] in ("[", "{") for k in texts):
                self.flat[tuple(node), types] = result, texts
        self.seen[id(node)] = node, result  # with the node, so that its id isn't used again
        return result

    @staticmethod
    def of_object(kids: dict[str, int]) -> tuple[int, str]:
        labels, states = kids.keys(), set(kids.values())
        has_text = any(x in labels for x in TEXT_LABELS)
        lists = LIST_LABELS.keys() & labels
        if "words" in labels or (SPAN_LABELS & labels and ("index" in labels or (SPANS in states and not lists))):
            return SEGMENT, ""
        if EVENT_LABELS & labels:
            return EVENT, ""
        if has_text and PANEL_LABELS & labels and "start" not in labels:
            if kids.get("bbox") == NUMBERS:
                return PANEL, "box_bbox"
            if kids.get("poly") == POLYGON:
                return PANEL, "box_poly"
            corners = all(kids.get(k, OTHER) in _NUMERIC for k in ("x1", "y1", "x2", "y2"))
            return PANEL, "box_corners" if corners else "box_bare"
        if has_text and not lists:
            return SPAN, "word_timed" if kids.get("start", OTHER) in _NUMERIC else "word_bare"
        # known by what it holds
        return (WRAPPER if states & {SEGMENTS, EVENTS, WRAPPER, SEGMENT, EVENT, SPANS, PANELS, PANEL} else OTHER), ""

    @staticmethod
    def of_list(states: set[int]) -> int:
        states = states - {NULL}
        if not states:
            return OTHER
        for one in _MANY:
            if one in states:
                return _MANY[one]
        return NUMBERS if states == {NUMBER} else POLYGON if states == {NUMBERS} else OTHER


def parents(automaton: TreeAutomaton, node, kind: str, label: str = "") -> Iterator[tuple[int, object]]:
    """(state, segment or event) in document order; None for a null among them."""
    if isinstance(node, str):
        node = automaton.decode(node)
    if label in LIST_LABELS and isinstance(node, (list, dict)):
        for x in items(node):
            yield LIST_LABELS[label], x
        return
    if not isinstance(node, (list, dict)):
        return
    state = automaton.state(node)
    if isinstance(node, list) or (node and all(k.isdecimal() for k in node)):
        if state in (SEGMENTS, EVENTS, SPANS, PANELS):
            # a bare list of spans or panels can only be known by the kind of its record
            of = SEGMENT if state == SEGMENTS else EVENT if state == EVENTS else SEGMENT if kind == "transcript" else EVENT
            for x in items(node):
                yield of, x
        elif state == WRAPPER:
            for x in items(node):
                yield from parents(automaton, x, kind)
        return
    if state in (SEGMENT, EVENT) and not LIST_LABELS.keys() & node.keys():
        yield state, node
        return
    for key, value in node.items():
        yield from parents(automaton, value, kind, key)


def children(automaton: TreeAutomaton, parent: dict, label: str) -> list:
    """The child nodes under ``label``, through wrappers such as ocr.res; without it, the list whose state is theirs."""
    value = parent.get(label)
    if value is not None:
        return items(automaton.decode(value) if isinstance(value, str) else value)
    for key in ("ocr", "res", "result", "data"):
        inner = parent.get(key)
        if isinstance(inner, str):
            inner = automaton.decode(inner)
        if isinstance(inner, dict) and (found := children(automaton, inner, label)):
            return found
    wanted = SPANS if label == "words" else PANELS
    for key, inner in parent.items():
        if isinstance(inner, (list, dict)) and key not in LIST_LABELS and automaton.state(inner) == wanted:
            return items(inner)
    return []


def number(value) -> float | None:
    if isinstance(value, bool) or value is None:
        return None
    try:
        return float(value)
    except (TypeError, ValueError):
        return None


def text_of(node) -> str | None:
    if isinstance(node, str):
        return node
    if isinstance(node, dict):
        for label in TEXT_LABELS:
            value = node.get(label)
            if isinstance(value, str):
                return value
            if isinstance(value, (int, float)) and not isinstance(value, bool):
                return str(value)
    return None


def rectangle(node: dict) -> tuple[int | None, ...]:
    """x1, y1, x2, y2 out of four fields, a bbox list or a polygon."""
    flat = node.get("bbox")
    if not isinstance(flat, list):
        poly = node.get("poly")
        points = [p for p in poly if isinstance(p, list) and len(p) == 2] if isinstance(poly, list) else []
        xs, ys = [number(p[0]) for p in points], [number(p[1]) for p in points]
        if points and None not in xs and None not in ys:
            return int(min(xs)), int(min(ys)), int(max(xs)), int(max(ys))
        flat = [node.get(k) for k in ("x1", "y1", "x2", "y2")]
    values = [number(v) for v in flat[:4]]
    return tuple(None if v is None else int(v) for v in values) if len(values) == 4 else (None,) * 4


def parse(payload: str | None):
    if payload is None:
        return None
    try:
        return json.loads(payload, parse_constant=_strict)
    except (ValueError, RecursionError):
        return None


def shred_record(automaton: TreeAutomaton, kind: str, payload: str | None) -> Iterator[tuple[str, int, dict | None, list]]:
    """(child kind, parent_pos, parent, children) of each segment and event of a record; positions count over all of it."""
    root = parse(payload)
    if root is None:
        return
    automaton.start_record()
    for pos, (state, parent) in enumerate(parents(automaton, root, kind)):
        label = "words" if state == SEGMENT else "boxes"
        yield CHILD_LABELS[label], pos, parent if isinstance(parent, dict) else None, children(automaton, parent, label) if isinstance(parent, dict) else []


def child_tables(records: DataFrame, keep_blank: bool = False, keys_only: bool = False) -> DataFrame:
    """One row per word or box, with the keys of its record and its parent.

    ``keys_only`` leaves out all but the supertype keys, so that nothing else is decoded or moved.
    """
    schema = "record_id bigint, child_kind string, parent_pos int, child_pos int" if keys_only else CHILD_SCHEMA

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = TreeAutomaton()
        out_schema = None
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                rows: list[list] = [[] for _ in range(4 if keys_only else 14)]
                for rid, kind, payload in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist()):
                    for child_kind, parent_pos, _, nodes in shred_record(automaton, kind or "", payload):
                        for child_pos, node in enumerate(nodes):
                            text = text_of(node)
                            if not keep_blank and (text is None or not text.strip()):
                                continue
                            row: tuple = (rid, child_kind, parent_pos, child_pos)
                            if not keys_only:
                                subtype = automaton.subtype(node) if isinstance(node, dict) else "bare"
                                # an object that holds no child's form has a text all the same, and nothing else
                                subtype = subtype if subtype.startswith(child_kind) else f"{child_kind}_bare"
                                node = node if isinstance(node, dict) else {}
                                score = number(node.get("probability", node.get("confidence")))
                                box = rectangle(node) if child_kind == "box" else (None,) * 4
                                row += (subtype, ",".join(sorted(node)), text, number(node.get("start")), number(node.get("end")), score, *box)
                            for column, value in zip(rows, row):
                                column.append(value)
                if out_schema is None:
                    kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), *[pa.float64()] * 3, *[pa.int32()] * 4]
                    names = [x.split()[0] for x in schema.split(", ")]
                    out_schema = pa.schema(list(zip(names, kinds)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, out_schema)], schema=out_schema)

    rows = records.select("record_id", "record_kind", "payload").filter(F.col("payload").isNotNull()).mapInArrow(run, schema)
    keys = ["record_id", "child_kind", "parent_pos", "child_pos"]
    return rows.distinct() if keys_only else rows.dropDuplicates(keys)


_KEYS = ("record_id", "parent_pos", "child_pos", "variant", "text")
_CORNERS = ("x1", "y1", "x2", "y2")
#: The columns of each subtype's table. Corners are those of the box, however it was given.
SUBTYPES = {
    "word_timed": (*_KEYS, "start", "end", "probability"),
    "word_bare": (*_KEYS, "probability"),
    "box_corners": (*_KEYS, "confidence", *_CORNERS),
    "box_bbox": (*_KEYS, "confidence", *_CORNERS),
    "box_poly": (*_KEYS, "confidence", *_CORNERS),
    "box_bare": (*_KEYS, "confidence"),
}


def subtype_table(children: DataFrame, subtype: str) -> DataFrame:
    """The typed table of one subtype out of child_tables."""
    named = {"probability": F.col("score").alias("probability"), "confidence": F.col("score").alias("confidence")}
    return children.filter(F.col("subtype") == subtype).select(*(named.get(c, c) for c in SUBTYPES[subtype]))


def subtype_tables(records: DataFrame, keep_blank: bool = False) -> dict[str, DataFrame]:
    """A typed table per subtype. Records are parsed again for each; ``write_subtypes`` parses them once."""
    children = child_tables(records, keep_blank)
    return {subtype: subtype_table(children, subtype) for subtype in SUBTYPES}


def write_subtypes(records: DataFrame, path: str, keep_blank: bool = False) -> None:
    """All children in one pass, a folder per subtype; read_subtype gives a subtype's typed table."""
    child_tables(records, keep_blank).write.mode("overwrite").partitionBy("subtype").parquet(path)


def read_subtype(spark: SparkSession, path: str, subtype: str) -> DataFrame:
    return subtype_table(spark.read.parquet(path), subtype)


OBJECT_SCHEMA = "record_id bigint, table string, place string, parent_table string, parent_place string, pos int, variant string, fields map<string, string>"


def object_rows(node, automaton: TreeAutomaton) -> Iterator[tuple]:
    """(table, place, parent table, parent place, pos, variant, fields) of each object of a list below ``node``."""
    lists: list[tuple[str, list]] = []
    scalars(node, "", automaton, {}, lists)
    waiting = [(lists, "", "")]
    while waiting:
        lists, label, at = waiting.pop()
        for name, members in lists:
            below = f"{label}.{name}" if label and name else label or name
            for pos, x in enumerate(members):
                x = automaton.decode(x) if isinstance(x, str) else x
                if not isinstance(x, (dict, list)):
                    continue
                here, own, inner = f"{at}/{name}:{pos}", {}, []
                scalars(x, "", automaton, own, inner)
                if isinstance(x, dict):
                    yield below, here, label, at, pos, ",".join(sorted(x)), own
                if inner:
                    waiting.append((inner, below, here))


def scalars(node, prefix: str, automaton: TreeAutomaton, fields: dict[str, str], lists: list[tuple[str, list]]) -> None:
    """Put an object's plain fields into ``fields`` and its lists of objects into ``lists``, through objects outside lists."""
    if isinstance(node, list):
        lists.append((prefix, node))
        return
    for label, value in node.items() if isinstance(node, dict) else ():
        name = f"{prefix}.{label}" if prefix else label
        inner = automaton.decode(value) if isinstance(value, str) and label not in TEXT_LABELS else value
        if isinstance(inner, dict) and inner and all(k.isdecimal() for k in inner):
            inner = items(inner)
        if isinstance(inner, list) and any(isinstance(x, (dict, list)) for x in inner) and automaton.state(inner) not in (NUMBERS, POLYGON):
            lists.append((name, inner))
        elif isinstance(inner, dict):
            scalars(inner, name, automaton, fields, lists)
        elif value is not None:
            fields[name] = value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def object_table(records: DataFrame, as_json: bool = False) -> DataFrame:
    """One row per object of any list of a record, whatever its label: OBJECT_SCHEMA, or with the fields as the text of a JSON object.

    Records are made distinct before they are taken apart, as all their objects are more than the record.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = TreeAutomaton()
        kinds = [pa.int64(), *[pa.string()] * 4, pa.int32(), pa.string(), pa.string()]
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                rows = []
                for rid, payload in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    root = parse(payload)
                    if root is not None:
                        automaton.start_record()
                        rows += [(rid, *row[:-1], dumps(row[-1])) for row in object_rows(root, automaton)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    names = [x.split()[0] for x in OBJECT_SCHEMA.split(", ")[:7]] + ["fields"]
    dumps = json.JSONEncoder(ensure_ascii=False).encode
    once = records.select(F.col("record_id").cast("long"), "payload").filter("payload IS NOT NULL").dropDuplicates(["record_id"])
    found = once.mapInArrow(run, OBJECT_SCHEMA.replace("map<string, string>", "string"))
    return found if as_json else found.withColumn("fields", F.from_json("fields", "map<string, string>"))


def parent_table(records: DataFrame) -> DataFrame:
    """One row per segment or event: the parents of child_tables, with their number of children."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = TreeAutomaton()
        kinds = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int32()]
        out_schema = pa.schema(list(zip([x.split()[0] for x in PARENT_SCHEMA.split(", ")], kinds)))
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                rows: list[list] = [[] for _ in out_schema]
                for rid, kind, payload in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist()):
                    for child_kind, pos, parent, nodes in shred_record(automaton, kind or "", payload):
                        parent = parent or {}
                        start = number(parent.get("start", parent.get("timestamp")))
                        frame = number(parent.get("frame_index"))
                        text = parent.get("text")
                        row = (rid, "segment" if child_kind == "word" else "event", pos, ",".join(sorted(parent)), text if isinstance(text, str) else None)
                        for column, value in zip(rows, (*row, start, number(parent.get("end")), None if frame is None else int(frame), len(nodes))):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, out_schema)], schema=out_schema)

    return records.select("record_id", "record_kind", "payload").filter(F.col("payload").isNotNull()).mapInArrow(run, PARENT_SCHEMA).dropDuplicates(["record_id", "parent_kind", "parent_pos"])


def variant_counts(records: DataFrame) -> DataFrame:
    """How often each structural variant of words and boxes occurs: the catalogue of subtype tables."""
    return child_tables(records, keep_blank=True).groupBy("child_kind", "subtype", "variant").agg(F.count("*").alias("n_children"), F.countDistinct("record_id").alias("n_records"))
