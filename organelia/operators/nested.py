"""Deeply nested rule sets as flat, typed tables that keep their parent links.

A tree automaton runs over each parsed document from the leaves up. A node may be read in several ways, so
it gets a set of states: those whose transition its fields and its children's states allow. From the root down each
node then takes the one state that its parent's transition asks for, and that state is the subtype table
it is routed to. Shapes that mean the same (a list of one element, text that itself holds JSON) are opened before,
so every written variant of a shape ends in the same state.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from organelia.session import cut, ship

NODES = "set_key string, node_id long, parent_id long, variant string, section string, name string, field string, pos int, item string"
_ARROW = pa.schema(
    [
        ("set_key", pa.string()), ("node_id", pa.int64()), ("parent_id", pa.int64()), ("variant", pa.string()), ("section", pa.string()),
        ("name", pa.string()), ("field", pa.string()), ("pos", pa.int32()), ("item", pa.string()),
    ]
)


class State:
    """What a node may be read as; a set of states is a sum. Plain numbers, since every node has one."""

    NUMBER = 1
    LOGICAL = 2
    TEXT = 4
    VALUES = 8  #: values in order; a single one is such a list too
    OVERLAP = 16
    RULE = 32
    NAMED = 64  #: a rule that says itself what it is for
    RULES = 128  #: rules by name, or a list of named ones
    SET = 256  #: a whole document


VALUE = State.NUMBER | State.LOGICAL | State.TEXT
#: The transitions of records: a record is read as a state by these of its fields, if the child may be read as one of the states given.
TRANSITIONS: dict[int, dict[str, int]] = {
    State.OVERLAP: {"start": VALUE, "stop": VALUE},
    State.NAMED: {"gene": VALUE},
    State.RULE: {"type": VALUE, "count": VALUE, "max_len": VALUE, "min_len": VALUE, "overlap": State.OVERLAP, "start_codons": State.VALUES, "stop_codons": State.VALUES},
    State.SET: {"default_rules": State.RULES, "rules": State.RULES},
}
#: The subtype table of a value: by its field and the state it has. A value of another state than its field's type is kept as text.
SUBTYPES: dict[tuple[str, int], str] = {
    **{(f, State.NUMBER): "limit" for f in ("count", "max_len", "min_len")},
    ("overlap.start", State.NUMBER): "overlap_start",
    ("overlap.stop", State.LOGICAL): "overlap_stop",
    **{("type", s): "type" for s in (State.NUMBER, State.LOGICAL, State.TEXT)},
    **{(f, s): "codon" for f in ("start_codons", "stop_codons") for s in (State.NUMBER, State.LOGICAL, State.TEXT)},
}

_LOGICAL = re.compile(r"(?i)true|false")
_NUMBER = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?")


class _Unreadable(ValueError):
    pass


def _parse(text: str) -> Any:
    """JSON with numbers left as they are written."""
    return json.loads(text, parse_int=str, parse_float=str, parse_constant=str)


def read_document(text: str | None) -> Any:
    """The parsed document of plain or base64 JSON text; raises where it can't be read."""
    if text is None or not text.strip():
        raise _Unreadable
    try:
        return _parse(text)
    except (ValueError, RecursionError):
        try:
            return _parse(base64.b64decode("".join(text.split()), validate=True).decode("utf-8"))
        except (ValueError, RecursionError, binascii.Error) as e:
            raise _Unreadable from e


def unwrap(node: Any) -> Any:
    """What a node contains: lists of one element and text that holds JSON are opened, as often as needed."""
    while True:
        if isinstance(node, list) and len(node) == 1:
            node = node[0]
        elif isinstance(node, str) and (s := node.strip())[:1] in ("{", "[", '"') and s:
            try:
                node = _parse(s)
            except (ValueError, RecursionError):
                return node
        else:
            return node


def plain(node: Any) -> str | None:
    """The text of a leaf; None for absent, null, empty and NA values and for what is no leaf."""
    if isinstance(node, bool):
        return "true" if node else "false"
    if isinstance(node, str):
        s = node.strip()
        if not s or s == "NA":
            return None
        return s.lower() if _LOGICAL.fullmatch(s) else s
    return None


class Node:
    """A node of a document: its children by field (a record) or in order (a list), or its text, and its states."""

    __slots__ = ("fields", "items", "text", "states")

    def __init__(self, value: Any) -> None:
        self.fields: dict[str, Node] | None = None
        self.items: list[Node] | None = None
        self.text = None if isinstance(value, (dict, list)) else plain(value)
        self.states = 0

    def read(self) -> None:
        """The states of a node whose children have theirs."""
        if self.fields is not None:
            # Any record may be a rule or a document: an empty one then says nothing.
            found = State.RULE | State.SET
            for state in (State.OVERLAP, State.NAMED):
                if any(f in self.fields and self.fields[f].states & child for f, child in TRANSITIONS[state].items()):
                    found |= state
            if found & State.NAMED or any(n.states & State.RULE for n in self.fields.values()):
                found |= State.RULES
        elif self.items is not None:
            found = 0
            for n in self.items:
                found |= State.VALUES if n.states & VALUE else n.states & (State.OVERLAP | State.RULES)
        elif self.text is None:
            found = 0
        else:
            found = State.VALUES | (State.LOGICAL if self.text in ("true", "false") else State.NUMBER if _NUMBER.fullmatch(self.text) else State.TEXT)
        self.states = found


def classify(document: Any) -> Node:
    """The root of a document whose nodes all have their states. Nothing here calls itself, so no depth is too deep."""
    value = unwrap(document)
    root = Node(value)
    order, stack = [], [(root, value)]
    while stack:
        node, value = stack.pop()
        order.append(node)
        if isinstance(value, dict):
            inner = {str(k): unwrap(v) for k, v in value.items()}
            node.fields = {k: Node(v) for k, v in inner.items()}
            stack += [(node.fields[k], v) for k, v in inner.items()]
        elif isinstance(value, list):
            inside = [unwrap(v) for v in value]
            node.items = [Node(v) for v in inside]
            stack += list(zip(node.items, inside, strict=True))
    # A node stands behind its parent.
    for node in reversed(order):
        node.read()
    return root


def _records(node: Node, state: int) -> Iterator[Node]:
    """The records that a node is, or lists, as a state."""
    for n in [node] if node.items is None else node.items:
        if n.fields is not None and n.states & state:
            yield n


def _rules(node: Node) -> Iterator[tuple[str, Node]]:
    """(name, rule) of a node that is read as rules."""
    for record in _records(node, State.RULES):
        if record.states & State.NAMED:
            yield record.fields["gene"].text, record
        else:
            yield from ((name, rule) for name, rule in record.fields.items() if rule.states & State.RULE)


def shred(key: str | None, text: str | None) -> Iterator[tuple]:
    """Rows of ``NODES`` for one document. Node ids count from 1 within the document; the root's parent is 0."""
    try:
        root = classify(read_document(text))
    except _Unreadable:
        root = None
    if root is None or not root.states & State.SET:
        yield (key, 1, 0, "unreadable", None, None, None, None, None)
        return
    yield (key, 1, 0, "set", None, None, None, None, None)
    last = 1

    def value(parent: int, section: str, name: str, field: str, pos: int, node: Node) -> tuple:
        nonlocal last
        last += 1
        return (key, last, parent, SUBTYPES.get((field, node.states & VALUE), "text"), section, name, field, pos, node.text)

    for section, asked in TRANSITIONS[State.SET].items():
        rules = root.fields.get(section)
        if rules is None or not rules.states & asked:
            continue
        for name, rule in _rules(rules):
            last += 1
            me = last
            yield (key, me, 1, "rule", section, name, None, None, None)
            for field, asked_of in TRANSITIONS[State.RULE].items():
                node = rule.fields.get(field)
                if node is None or not node.states & asked_of:
                    continue
                if asked_of == State.OVERLAP:
                    for record in _records(node, State.OVERLAP):
                        for inner, wanted in TRANSITIONS[State.OVERLAP].items():
                            if inner in record.fields and record.fields[inner].states & wanted:
                                yield value(me, section, name, f"{field}.{inner}", 1, record.fields[inner])
                elif asked_of == State.VALUES:
                    for pos, n in enumerate([node] if node.items is None else node.items, 1):
                        if n.states & VALUE:
                            yield value(me, section, name, field, pos, n)
                else:
                    yield value(me, section, name, field, 1, node)


def rule_nodes(df: DataFrame, key: str = "curate_opts", params: str = "params") -> DataFrame:
    """All nodes of the nested documents in ``params``, one row per node (``NODES``).

    ``variant`` is the subtype: ``set`` and ``unreadable`` (roots), ``rule``, and of values ``limit``, ``type``,
    ``overlap_start``, ``overlap_stop``, ``codon``, or ``text`` where a value is not of its field's type. (set_key,
    node_id) identifies a node within its document and ``parent_id`` links it to its parent. Rows are read
    in Arrow batches without a shuffle: a document is one row, so a key with many rows needs no special care. NULL,
    empty and malformed text, documents that are no object, and those nested deeper than the parser reads
    give one ``unreadable`` row; a NULL key is kept. Copies of a row give copies of its nodes; columns other than
    the two named are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [row for k, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for row in shred(k, p)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _ARROW.types, strict=True)], schema=_ARROW)

    ship(df.sparkSession)
    return df.select(F.col(key).cast("string"), F.col(params).cast("string")).mapInArrow(run, NODES)


#: Subtype tables of values, the variant that each holds, and the type of its ``value``.
VALUE_TABLES = {"limits": ("limit", "double"), "types": ("type", "string"), "overlap_starts": ("overlap_start", "double"), "overlap_stops": ("overlap_stop", "boolean"),
    "codons": ("codon", "string"), "texts": ("text", "string")}


def rule_tables(nodes: DataFrame) -> dict[str, DataFrame]:
    """The typed subtype tables of ``rule_nodes``.

    All share the supertype's key set_key, node_id and the parent link parent_id; tables of values have section, name,
    field, pos, the value as text (``item``) and typed (``value``).
    """
    link = ["set_key", "node_id", "parent_id"]
    of = lambda v: nodes.where(F.col("variant") == v)
    tables = {"sets": of("set").select(*link), "unreadable": of("unreadable").select(*link), "rules": of("rule").select(*link, "section", "name")}
    for name, (variant, kind) in VALUE_TABLES.items():
        tables[name] = of(variant).select(*link, "section", "name", "field", "pos", "item", F.col("item").try_cast(kind).alias("value"))
    return tables


def rule_values(df: DataFrame, key: str = "curate_opts", params: str = "params") -> DataFrame:
    """(curate_opts, section, name, field, pos, item): every rule value of the readable documents, distinct.

    The union of the typed tables; documents are parsed once, into the checkpoint folder.
    """
    tables = rule_tables(cut(rule_nodes(df.select(key, params).distinct(), key, params)))
    parts = [tables[t].select(F.col("set_key").alias("curate_opts"), "section", "name", "field", "pos", "item") for t in VALUE_TABLES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.distinct()
