"""License scans: templates with optional and replaceable regions, as token automata.

A template is wording with mark-up: ``<<beginOptional>>`` ... ``<<endOptional>>`` around words that
may be left out, ``<<var;name=...;original=...;max=N>>`` for up to N free words. Instead of ``max``
a variable may have a ``match``: ``.*`` any number of words, ``.+`` one word or more, ``.{a,b}`` up to
half as many words as b characters hold. All other words are
mandatory: they must stand in order, word for word. A template compiles to a token automaton;
a text is accepted wherever the automaton runs from its start to its end.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loomwright.llm.common import narrow, register, text_chunks
from loomwright.queries.base import table

# Fixed phrases of the base scan and their labels.
BASE_PHRASES = {
    "cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved",
}
# Templates of this operator, by label.
TEMPLATES = {
    "apache": "<<beginOptional>>Licensed under the<<endOptional>> Apache License"
              "<<beginOptional>> Version <<var;name=version;original=2.0;max=2>><<endOptional>>",
    "cc-by-nc": "<<beginOptional>>Licensed under<<endOptional>> CC BY NC"
                "<<beginOptional>> <<var;name=version;original=4.0;max=2>><<endOptional>>",
    "copyright": "Copyright <<beginOptional>>c<<endOptional>> <<var;name=owner;original=;max=12>> All rights reserved",
    "gpl": "<<beginOptional>>This work is <<endOptional>>Licensed under the GNU General Public License"
           "<<beginOptional>> version <<var;name=version;original=3;max=2>><<endOptional>>",
    "mit": "<<beginOptional>>Released under<<endOptional>> the MIT License",
}

# Bytes that are no word characters become a space, A-Z become lower case. Every byte above
# 127 belongs to a word.
_WORDS = bytes(
    b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32
    for b in range(256)
)


def words_of(text: str | bytes) -> list[bytes]:
    raw = text.encode() if isinstance(text, str) else text
    return raw.translate(_WORDS).split()


@dataclass
class Automaton:
    """States 0..n; ``step`` by word, ``free`` by any word, ``skip`` without one; ends at ``last``."""

    last: int = 0
    step: dict[int, dict[bytes, int]] = field(default_factory=dict)
    free: dict[int, int] = field(default_factory=dict)
    skip: dict[int, set[int]] = field(default_factory=lambda: defaultdict(set))

    def closure(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for t in self.skip.get(todo.pop(), ()):
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return seen

    def first_words(self) -> set[bytes]:
        return {w for s in self.closure({0}) for w in self.step.get(s, {})}

    def longest(self, words: list[bytes], start: int) -> int | None:
        """End of the longest accepted run from ``start``, or None."""
        states, end, at = self.closure({0}), None, start
        while states:
            if self.last in states and at > start:
                end = at
            if at == len(words):
                break
            word, moved = words[at], set()
            for s in states:
                if (t := self.step.get(s, {}).get(word)) is not None:
                    moved.add(t)
                if s in self.free:
                    moved.add(self.free[s])
            states, at = self.closure(moved), at + 1
        return end


_MARK = re.compile(r"<<(beginOptional|endOptional|var)([^>]*)>>")


def _match_of(attributes: str) -> str | None:
    found = re.search(r'match="?([^";]*)"?', attributes)
    return found[1] if found else None


def _most_words(attributes: str) -> int | None:
    """How many words a variable stands for at most; None: any number."""
    if (found := re.search(r"max=(\d+)", attributes)) is not None:
        return int(found[1])
    match = _match_of(attributes)
    if match in (".*", ".+"):
        return None
    if match and (found := re.fullmatch(r"\.\{\d*,(\d+)\}", match)):
        return -(-int(found[1]) // 2)  # a word has a character and a separator at least
    raise ValueError(f"a variable needs max=N or match of .*, .+ or .{{a,b}}, not <<var{attributes}>>")


def compile_template(template: str) -> Automaton:
    """The automaton of a template. Regions nest; a template without any mandatory word, an unclosed
    region or a start that is a free word is refused, since it would accept anything."""
    machine, opened, mandatory = Automaton(), [], 0

    def add_words(text: str) -> int:
        words = words_of(text)
        for w in words:
            machine.step.setdefault(machine.last, {})[w] = machine.last + 1
            machine.last += 1
        return len(words)

    at = 0
    for m in _MARK.finditer(template):
        mandatory += add_words(template[at:m.start()]) * (not opened)
        at = m.end()
        if m[1] == "beginOptional":
            opened.append(machine.last)
        elif m[1] == "endOptional":
            if not opened:
                raise ValueError("endOptional without beginOptional")
            machine.skip[opened.pop()].add(machine.last)
        else:
            if machine.last == 0:
                raise ValueError("a template cannot start with a replaceable region")
            most = _most_words(m[2])
            begin = machine.last
            if most is None:  # any number: the state behind the first free word stays in place
                machine.free[begin] = machine.free[begin + 1] = begin + 1
                machine.last += 1
                if _match_of(m[2]) == ".*":
                    machine.skip[begin].add(begin + 1)
                continue
            for _ in range(most):
                machine.free[machine.last] = machine.last + 1
                machine.last += 1
            for s in range(begin, machine.last):
                machine.skip[s].add(machine.last)
    mandatory += add_words(template[at:]) * (not opened)
    if opened or not mandatory:
        raise ValueError("a template needs mandatory words and closed regions")
    return machine


class Scanner:
    """Base phrases and templates, started only at words they can begin with."""

    def __init__(self, phrases: dict[str, str], templates: dict[str, str]):
        self.phrases = [(words_of(p), label) for p, label in phrases.items()]
        self.machines = {label: compile_template(t) for label, t in templates.items()}
        self.starts: dict[bytes, list[tuple[str, Automaton]]] = defaultdict(list)
        for label, machine in self.machines.items():
            for w in machine.first_words():
                self.starts[w].append((label, machine))
        self.firsts = {p[0] for p, _ in self.phrases} | set(self.starts)
        self.any_first = re.compile(rb"(?:^| )(?:" + b"|".join(map(re.escape, sorted(self.firsts))) + rb")(?: |$)")

    def scan(self, plain: bytes) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
        """Base and template matches (start, end, label) of a translated text."""
        if not self.any_first.search(plain):
            return [], []
        words = plain.split()
        base, matched = [], []
        for at, word in enumerate(words):
            if word not in self.firsts:
                continue
            for phrase, label in self.phrases:
                if words[at:at + len(phrase)] == phrase:
                    base.append((at, at + len(phrase), label))
            for label, machine in self.starts.get(word, ()):
                if (end := machine.longest(words, at)) is not None:
                    matched.append((at, end, label))
        return base, matched


FOUND = (
    "doc_id long, n_words long, base array<struct<start: long, end: long, label: string>>, "
    "matches array<struct<start: long, end: long, label: string>>"
)


def scan(
    docs: DataFrame,
    phrases: dict[str, str] = BASE_PHRASES,
    templates: dict[str, str] = TEMPLATES,
) -> DataFrame:
    """One row per input row: number of words, all places of base phrases and of templates.

    Places count words from 0, ends are exclusive; of one template the longest match from each
    start. Null or empty text: no words, no places. Repeated rows are scanned each; columns
    other than doc_id and text are not read.
    """
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, templates)
        for batch, data, offsets in text_chunks(batches):
            plain = data.tobytes().translate(_WORDS)
            counts, base, matched = [], [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                text = plain[a:b]
                inner = np.frombuffer(text, np.uint8) != 32
                counts.append(int((inner[1:] & ~inner[:-1]).sum()) + int(len(inner) and inner[0]))
                found = scanner.scan(text)
                base.append([dict(zip(("start", "end", "label"), x)) for x in found[0]])
                matched.append([dict(zip(("start", "end", "label"), x)) for x in found[1]])
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(counts, pa.int64()),
                 pa.array(base, pa.list_(span)), pa.array(matched, pa.list_(span))],
                ["doc_id", "n_words", "base", "matches"],
            )

    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return source.mapInArrow(run, FOUND)


def labelled(found: DataFrame) -> DataFrame:
    """Labels and a score: the share of words in some match; 0 without words."""
    labels = lambda c: F.transform(c, lambda x: x["label"])
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    spans = F.array_sort(F.concat("base", "matches"))
    zero = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0).cast("long").alias("sum"))
    covered = F.aggregate(
        spans, zero,
        lambda acc, x: F.struct(
            F.greatest(acc["upto"], x["end"]).alias("upto"),
            (acc["sum"] + F.greatest(F.lit(0), x["end"] - F.greatest(acc["upto"], x["start"]))).alias("sum")),
        lambda acc: acc["sum"],
    )
    starts = F.transform("base", lambda x: x["start"])
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(labels("base")).alias("base_labels"),
        joined(F.concat(labels("base"), labels("matches"))).alias("labels"),
        F.when(F.col("n_words") > 0, covered / F.col("n_words")).otherwise(F.lit(0.0)).alias("score"),
        F.size("matches").cast("long").alias("n_matches"),
    )


def op5(spark, sf_dir) -> DataFrame:
    return labelled(scan(narrow(table(spark, sf_dir, "documents"), "doc_id", "text")))


register("op5_licenses", op5)
