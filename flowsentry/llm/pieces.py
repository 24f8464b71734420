"""Cutting texts where every byte-level pre-tokenizer of this pattern family cuts, so that equal pieces are encoded once."""

from __future__ import annotations

import re
import sys

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])

TWO_SPACES = re.compile(r"\s\s")
_CUT = re.compile(r"(?<=\S)(?= )")
#: Characters that can mark the cuts of texts that do not hold them.
MARKS = "\x01\x02\x03\x04\x05\x06\x07\x08\ue000\uf8ff"


def pieces(text: str) -> list[str]:
    """`text` cut before each space that follows something other than white space, and around line ends that
    stand alone.

    No match of the pattern holds a space after another kind of character, and what a match looks ahead at is
    never beyond such a place, so encoding the pieces one by one gives the ids of the whole text. A line end
    between two other characters is a match by itself.
    """
    if TWO_SPACES.search(text):
        return _CUT.split(text)
    out = []
    for line in text.split("\n"):
        head, *rest = line.split(" ")
        if head:
            out.append(head)
        out += [" " + x for x in rest]
        out.append("\n")
    out.pop()
    return out


def lists(texts: list[str]) -> pa.ListArray:
    """The pieces of each text. There may be empty ones among them, which are to be left out."""
    mark = next((m for m in MARKS if not any(m in t for t in texts)), None)
    if mark is None:
        return pa.array([pieces(t) for t in texts], pa.list_(pa.string()))
    return pc.split_pattern(pa.array(
        [mark.join(pieces(t)) if TWO_SPACES.search(t) else
         t.replace("\n", f"{mark}\n{mark}").replace(" ", mark + " ") for t in texts], pa.string()), mark)
