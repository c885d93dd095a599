"""Licence recognition by sentences and rules.

A text is cut into sentences, each is reduced to lower-case words and looked up among known licence
sentences.  What is left is a sequence of sentence identifiers, which is matched from left to right
against ordered rules; the longest rule that fits wins.
"""

from __future__ import annotations

import re
from itertools import islice

from pyspark.sql import DataFrame

from stemma.llm.common import map_rows
from stemma.llm.license_texts import RULES, SENTENCES

#: A sentence ends at a full stop, colon, question or exclamation mark before white space or the end, or with its line.
END = re.compile(r"[.!?:]+(?=\s|$)|\n\s*")
WORD = re.compile(r"[^\W_]+")
#: Words that a star stands for at most.
GAP = 12
JUNK = re.compile(r"[\W_]+")


def normal(sentence: str) -> str:
    return JUNK.sub(" ", sentence.lower()).strip()


def lengths(words: list[str], head: list[str], tail: list[list[str]]) -> list[int]:
    """With how many of the first words a form (parts between stars) may end."""
    if words[: len(head)] != head:
        return []
    ends = [len(head)]
    for part in tail:
        ends = sorted({e + g + len(part) for e in ends for g in range(GAP + 1) if e + g + len(part) <= len(words) and words[e + g : e + g + len(part)] == part})
    return ends


class Recogniser:
    def __init__(self, sentences: dict[str, list[str]] = SENTENCES, rules=RULES):
        # by the first two words, or the only one before a star
        self.forms: dict[tuple[str, ...], list] = {}
        for name, forms in sentences.items():
            for form in forms:
                head, *tail = [normal(p).split() for p in form.split("*")]
                if not head:
                    raise ValueError(f"a form of {name} doesn't begin with a word")
                self.forms.setdefault(tuple(head[:2]), []).append((head, tail, name))
        self.firsts = {key[0] for key in self.forms}
        every = [f for fs in self.forms.values() for f in fs]
        self.longest = max((len(h) + sum(len(t) + GAP for t in tail) for h, tail, _ in every), default=0)
        self.rules = sorted(rules, key=lambda r: -len(r[0]))

    def identifiers(self, text: str | None) -> list[tuple[int, int, str]]:
        """(begin, end, identifier) in order.

        A sentence begins after another's end or with a line; it may be wrapped over any number of lines
        and have full stops inside ("v. 2.0"), as only its words count.
        """
        if not text:
            return []
        starts = {}
        for at in [0, *(m.end() for m in END.finditer(text))]:
            first = WORD.search(text, at)
            if first and first[0].lower() in self.firsts:
                starts[first.start()] = at
        found = []
        for first, at in starts.items():
            begin = tuple(m[0].lower() for m in islice(WORD.finditer(text, first), 2))
            forms = self.forms.get(begin, []) + (self.forms.get(begin[:1], []) if len(begin) > 1 else [])
            if not forms:
                continue
            words = list(islice(WORD.finditer(text, first), self.longest + 1))
            plain = [m[0].lower() for m in words]
            ends = []
            for head, tail, name in forms:
                for n in lengths(plain, head, tail):
                    end = END.search(text, words[n - 1].end())
                    stop = end.start() if end else len(text)
                    if n == len(words) or stop <= words[n].start():
                        ends.append((stop, name))
            if ends:
                stop, name = max(ends)
                found.append((at + len(text[at:first]) - len(text[at:first].lstrip()), stop, name))
        out, reach = [], -1
        for a, b, name in sorted(found):
            if a >= reach:
                out.append((a, b, name))
                reach = b
        return out

    def licences(self, text: str | None) -> list[tuple[str, int, int, int]]:
        """(licence, begin, end, sentences) for each rule met, from left to right."""
        ids, out, at = self.identifiers(text), [], 0
        names = [n for *_, n in ids]
        while at < len(ids):
            for want, licence in self.rules:
                if tuple(names[at : at + len(want)]) == want:
                    out.append((licence, ids[at][0], ids[at + len(want) - 1][1], len(want)))
                    at += len(want)
                    break
            else:
                at += 1
        return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: dict[str, list[str]] = SENTENCES, rules=RULES) -> DataFrame:
    """id, license, begin_char, end_char, n_sentences: one row per licence found in a document, in whole texts.

    Null and empty texts have none; null ids and repeated rows stay; an empty table gives no rows; other
    columns are not looked at.
    """

    def make():
        known = Recogniser(sentences, rules)
        return lambda columns: [(i, *hit) for i, t in zip(*columns, strict=True) for hit in known.licences(t)]

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs.select(id_col, text_col), make, f"{id_col} {kind}, license string, begin_char long, end_char long, n_sentences int")
