"""Pages of keywords, links or tags instead of sentences, found by how their terms recur.

The whole text becomes one sequence of tokens. For each word the operator looks at a window around it:

- *recurrence gaps*: the share of content words that stood within the last ``LAG`` words before or stand within the
  next ``LAG`` after (prose seldom says a content word again so soon);
- *positional autocorrelation*: the largest share, over the lags 1 to ``LAG`` // 2, of words equal to the word a lag
  before (lists of keywords repeat at a regular distance);
- the share of *function words* of the corpus's languages, articles apart (lists of distinct nouns have none).

A word is stuffing if its window recurs unnaturally, or has hardly any function words outside figures and code.
The lists of function words know a few languages only. A text that has almost none of them but is built of sentences
(letters between full stops of any script in a usual number) is of another language: there words of up to ``SHORT_WORD``
letters count as function words, and only recurrence speaks against it, never the lack of function words.
A line is code by the density of its signs, with a call or a back quote among them, not by their number.
Links, link texts' urls and hash tags are stuffing by themselves. A document is flagged when stuffing makes up more
than ``share`` of its characters in tokens. Everything is vectorised over a batch of documents; nothing is truncated.

Defined cases: null, empty and blank texts and texts without words are never flagged (share 0); a text of fewer than
``LEAST_WORDS`` words is no list; a document is judged
by itself, so repeated rows get equal results; a row without id is left
out; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

#: Articles and particles that stand inside noun phrases, also in lists of them.
ARTICLES = frozenset("the a an of der die das den dem des ein eine einen einem einer eines le la les l un une du de d los las el lo unos unas del".split())  # noqa: SIM905
#: Other function words of English, German, French and Spanish; sentences need them, lists of nouns don't.
FUNCTION_WORDS = frozenset(
    """
    to in and that is are was were be been for with we on it as by from at this these those not no or but if then than
    which who whom whose has have had do does did can could will would should may might our your their its his her they he she you i
    there here so because while when where what how up down about into over after before more most some any all each other such only
    since without once even until unless whenever yet although though both between per via
    und oder aber nicht ist sind war wird werden von vom zu zum zur mit auf im am an bei für als wie wenn dass weil sich sie er es wir
    ihr ihre sein seine auch noch nur nach aus um über unter durch bis seit obwohl während doch solange sobald
    hat haben hatte wurde wurden kann können man mehr sehr hier dort vor zwischen diese dieser diesem dieses ihnen uns bevor zurück sodass
    et ou mais ne n pas est sont était par pour dans sur avec sans qui que qu ce cette ces se s sa son ses il elle ils elles nous vous
    on au aux plus très y en comme si leur leurs avait tant après depuis parce
    selon ont même moins dès alors dont cela ni entre vers sous chez autres quand aussi
    al o pero es fue por para con sin su sus como más muy no este esta tras hasta porque cuando aunque mientras desde
    según incluso menos sigue otros ha han hay ser cada entre sobre así antes nada ni
    """.split()  # noqa: SIM905
)
LAG = 40
HALF_WINDOW = 12
HALF_WIDE = 40
LEAST_WORDS = 8
SHORT_WORD = 3
UNKNOWN = 0.14
SENTENCE_LETTERS = (15, 600)
_STOP = regex.compile(r"[\p{L}\p{M}\p{N}\"'”»)\]](?:[.!?…։؟۔።]+(?=\s|$)|[。！？।॥]+)")
_LETTER = regex.compile(r"[\p{L}\p{M}]")
_TOKEN = regex.compile(r"https?://[^\s\"'<>)\]]+|www\.[^\s\"'<>)\]]+|(?:#|(?<!\S)\+|(?<!\S)tag:)[\p{L}_][\p{L}\p{N}_]+|</?(?!a\b)[a-z][^<>]{0,200}>|\n|&[a-z#0-9]+;|[\p{L}\p{M}]+|\p{N}[\p{N}.,:%]*|=|(?<=\p{L})\(|`")
_NEWLINE, _WORD, _FUNCTION, _NUMBER, _LINK, _SIGN, _MARKUP, _ARTICLE = range(8)


def _kind(token: str) -> int:
    head = token[0]
    if head == "\n":
        return _NEWLINE
    if head in "#+" or token.startswith(("http://", "https://", "www.", "tag:")):
        return _LINK
    if head in "=(`":
        return _SIGN
    if head in "<&":
        return _MARKUP
    if head.isalpha():
        return _FUNCTION if token in FUNCTION_WORDS else _ARTICLE if token in ARTICLES else _WORD
    return _NUMBER


def _is_sentences(text: str) -> bool:
    """Whether a text of an unknown language is made of sentences; links don't count."""
    bare = regex.sub(r"\S*(?:://|www\.)\S*", " ", text)
    stops, letters = len(_STOP.findall(bare)), len(_LETTER.findall(bare))
    return stops > 0 and SENTENCE_LETTERS[0] <= letters / stops <= SENTENCE_LETTERS[1]


def _window_sum(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[high] - total[low]


class _Codes(dict):
    """Token to code; knows each code's kind and length."""

    def __init__(self):
        self.kinds: list[int] = []
        self.sizes: list[int] = []

    def __missing__(self, token: str) -> int:
        code = self[token] = len(self.kinds)
        kind = _kind(token)
        self.kinds.append(kind)
        self.sizes.append(0 if kind in (_NEWLINE, _SIGN, _MARKUP) else len(token))
        return code


def stuffing_share(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: the share of stuffing, the mean recurrence share and the mean of the best autocorrelation."""
    codes = _Codes()
    parts, lengths = [], []
    for text in texts:
        found = [codes[t] for t in _TOKEN.findall(text.lower().replace("@", "a"))] if text else []  # @ is the usual disguise of a letter
        parts.append(np.array(found, np.int64))
        lengths.append(len(found))
    n = len(texts)
    share, recurrence, regularity = np.zeros(n), np.zeros(n), np.zeros(n)
    if not sum(lengths):
        return share, recurrence, regularity
    codes["="]
    token = np.concatenate(parts)
    doc = np.repeat(np.arange(n), lengths)
    kind, size = np.array(codes.kinds)[token], np.array(codes.sizes, float)[token]

    # texts of other languages
    by_doc = lambda mask: np.bincount(doc, mask, n)
    known, spoken = by_doc((kind == _FUNCTION) | (kind == _ARTICLE)), by_doc((kind == _WORD) | (kind == _FUNCTION) | (kind == _ARTICLE))
    foreign = np.zeros(n, bool)
    for i in np.flatnonzero((spoken >= LEAST_WORDS) & (known < UNKNOWN * spoken)):
        foreign[i] = _is_sentences(texts[i])
    if foreign.any():
        kind[foreign[doc] & (kind == _WORD) & (size <= SHORT_WORD)] = _FUNCTION

    # figures and code, by line
    first = np.concatenate([[True], doc[1:] != doc[:-1]])
    line = np.cumsum((kind == _NEWLINE) | first) - 1
    per_line = lambda mask: np.bincount(line, mask, line[-1] + 1)
    numbers, words, links = per_line(kind == _NUMBER), per_line((kind == _WORD) | (kind == _FUNCTION) | (kind == _ARTICLE)), per_line(kind == _LINK)
    signs, functions = per_line(kind == _SIGN), per_line(kind == _FUNCTION)
    calls = per_line((kind == _SIGN) & (token != codes["="]))
    plain = (links == 0) & (((numbers >= 2) & (numbers >= words)) | ((signs >= 2) & (signs >= 0.15 * words) & (calls >= 1) & (functions <= 0.2 * words)))
    plain_token = plain[line]

    # the sequence of words
    at = np.flatnonzero((kind == _WORD) | (kind == _FUNCTION) | (kind == _ARTICLE))
    stuffed = kind == _LINK
    if len(at):
        w, d, function = token[at], doc[at], (kind[at] == _FUNCTION)
        place = np.arange(len(at))
        starts = np.searchsorted(d, np.arange(n))
        ends = np.searchsorted(d, np.arange(n), side="right")
        low, high = np.maximum(place - HALF_WINDOW, starts[d]), np.minimum(place + HALF_WINDOW + 1, ends[d])
        order = np.lexsort((place, w, d))
        same = (w[order][1:] == w[order][:-1]) & (d[order][1:] == d[order][:-1])
        gap = np.where(same, np.diff(order), 1 << 30)
        near = np.zeros(len(at), bool)
        close = gap <= LAG
        near[order[1:][close]] = True
        near[order[:-1][close]] = True
        content = kind[at] == _WORD
        n_window = (high - low).astype(float)
        n_content = _window_sum(content, low, high)
        f_share = _window_sum(function, low, high) / n_window
        r_share = _window_sum(near & content, low, high) / np.maximum(n_content, 1)
        best = np.zeros(len(at))
        for lag in range(1, LAG // 2 + 1):
            match = np.zeros(len(at), bool)
            match[lag:] = (w[lag:] == w[:-lag]) & (d[lag:] == d[:-lag]) & content[lag:]
            if match.any():
                np.maximum(best, _window_sum(match, low, high) / np.maximum(n_content, 1), out=best)
        far_low, far_high = np.maximum(place - HALF_WIDE, starts[d]), np.minimum(place + HALF_WIDE + 1, ends[d])
        f_wide = _window_sum(function, far_low, far_high) / (far_high - far_low)
        r_wide = _window_sum(near & content, far_low, far_high) / np.maximum(_window_sum(content, far_low, far_high), 1)
        figure = _window_sum(plain_token[at], low, high) > 0.5 * n_window
        a_share = 1 - n_content / n_window
        regular = ((r_share >= 0.75) & (r_wide >= 0.58)) | ((r_share >= 0.6) & (best >= 0.3) & (r_wide >= 0.5)) | ((r_share >= 0.4) & (f_share < 0.07) & ~foreign[d])
        regular |= (r_wide >= 0.62) & (r_share >= 0.5)
        listed = (a_share < 0.08) | ((f_wide < 0.045) & (f_share < 0.1) & (r_wide >= 0.25) & (far_high - far_low >= 12))
        listed &= ((ends - starts)[d] >= LEAST_WORDS) & ~foreign[d]
        stuffed[at] = (regular | listed) & ~figure & ~plain_token[at]
        count = np.maximum(np.bincount(d, minlength=n), 1)
        recurrence, regularity = np.bincount(d, r_share, n) / count, np.bincount(d, best, n) / count
    # figures among stuffing are part of it (prices, counts); elsewhere they are figures
    number = np.flatnonzero((kind == _NUMBER) & ~plain_token)
    if len(at) and len(number):
        before = np.clip(np.searchsorted(at, number) - 1, 0, len(at) - 1)
        stuffed[number] = stuffed[at[before]] & (doc[at[before]] == doc[number])
    total = np.bincount(doc, size, n)
    share = np.where(total > 0, np.bincount(doc, size * stuffed, n) / np.maximum(total, 1), 0.0)
    return share, recurrence, regularity


def stuffing(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, stuffing, recurrence, regularity`` of each document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 512):
                part = pdf.iloc[lo : lo + 512]
                share, recurrence, regularity = stuffing_share(list(part.iloc[:, 1]))
                yield pd.DataFrame({"id": part.iloc[:, 0].to_numpy(), "stuffing": share, "recurrence": recurrence, "regularity": regularity})

    rows = documents.select(documents[id_col].alias("id"), documents[text_col].alias("text")).where("id IS NOT NULL")
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInPandas(run, f"id {kind}, stuffing double, recurrence double, regularity double")


def flag_stuffed(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = 0.5) -> DataFrame:
    """``id`` of the documents of which more than ``share`` is stuffing."""
    return stuffing(documents, id_col, text_col).where(f"stuffing > {share}").select("id").distinct()
