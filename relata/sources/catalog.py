"""Catalog text: blocks of BEGIN, relation, data file, attribute lines, END."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

TYPES = {"Int": T.IntegerType(), "Double": T.DoubleType(), "String": T.StringType()}


@dataclass(frozen=True)
class Relation:
    name: str
    file: str
    schema: T.StructType


def make_schema(attributes: list[tuple[str, str]]) -> T.StructType:
    """A schema from (name, type) pairs."""
    if unknown := [t for _, t in attributes if t not in TYPES]:
        raise ValueError(f"unknown types {unknown}")
    return T.StructType([T.StructField(n, TYPES[t], False) for n, t in attributes])


def parse(text: str) -> dict[str, Relation]:
    out: dict[str, Relation] = {}
    block: list[str] | None = None
    for line in map(str.strip, text.splitlines()):
        if line == "BEGIN":
            block = []
        elif line == "END":
            if block is None or len(block) < 2:
                raise ValueError("END without a relation")
            attributes = [tuple(x.split()) for x in block[2:]]
            if any(len(a) != 2 for a in attributes):
                raise ValueError(f"bad attribute in {block[0]}")
            out[block[0]] = Relation(block[0], block[1], make_schema(attributes))
            block = None
        elif line and block is not None:
            block.append(line)
    if block is not None:
        raise ValueError("relation without END")
    return out


def render(relations: dict[str, Relation]) -> str:
    names = {type(t): n for n, t in TYPES.items()}
    return "\n".join("\n".join(["BEGIN", r.name, r.file, *(f"{f.name} {names[type(f.dataType)]}" for f in r.schema), "END", ""]) for r in relations.values())
