"""Source documents and layered settings."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLOW = "pos int, type string, text string, problem string"


def _flow(items: list, out: list[tuple]) -> None:
    """Appends (type, text) of a content tree in reading order; what hangs below a heading follows it."""
    waiting = list(reversed(items))
    while waiting:
        item = waiting.pop()
        kind = str(item.get("type", "paragraph"))
        text = str(item.get("content", item.get("text", "")) or "")
        if kind == "heading":
            out.append((f"heading{item.get('level', 1)}", text))
        elif kind == "list":
            numbered = item.get("list_type") == "ordered"
            out += [("paragraph", f"{n}. {x}" if numbered else f"- {x}") for n, x in enumerate(map(str, item.get("items", [])), 1) if x.strip()]
        else:
            out.append(("paragraph" if kind == "hatnote" else kind, text))
        waiting.extend(reversed(item.get("children") or []))


def flow_of(value: str | None) -> tuple[list[tuple], str | None]:
    """Items of a source document and what is wrong with it: its content tree if it has one, else its flat elements as they are."""
    try:
        found = json.loads(value or "")
        tree, flat = found.get("content"), found.get("elements")
        out: list[tuple] = []
        if tree:
            _flow(tree, out)
        elif isinstance(flat, list):
            out = [(str(e["type"]), str(e.get("content", e.get("text", "")) or "")) for e in flat]
        else:
            return [], "no_content"
        return out, None
    except ValueError:
        return [], "not_json"
    except (AttributeError, KeyError, TypeError):
        return [], "schema_invalid"


def source_items(documents: DataFrame, key: str = "doc_id", value: str = "value") -> DataFrame:
    """(key, FLOW) of JSON source documents; one that can't be read has one row with its problem."""
    kind = documents.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            rows = []
            for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                items, problem = flow_of(v)
                rows += [(k, None, None, None, problem)] if problem else [(k, i, *x, None) for i, x in enumerate(items)]
            types = (b.column(0).type, pa.int32(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, types, strict=True)], names=[key, "pos", "type", "text", "problem"])

    return documents.select(key, value).mapInArrow(run, f"`{key}` {kind}, {FLOW}")


def setting(layers: list[Column], path: str) -> Column:
    """The first value that is not null at a dotted path, over layers of settings in JSON, the most special first."""
    return F.coalesce(*[F.get_json_object(layer, "$." + path) for layer in layers])
