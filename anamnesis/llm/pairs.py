"""Defects of question and answer pairs, by ordered rules on both texts and the stored state.

Every rule that holds is given out; the first one in the order of DEFECTS names the pair. The rules
are per pair, so Spark only deals out the pairs; folding a pair's saved states comes before.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from anamnesis.llm import phrases as P

DEFECTS = ("empty", "refusal", "echo", "other_language", "truncated")
CUT_STATUS = {"truncated", "failed", "interrupted"}
CUT_REASON = {"length", "max_tokens", "content_filter", "cancelled"}

_HIDDEN = re.compile(r"[​-‏‪-‮⁠-⁤﻿­︎️⃣]")
_TAGS = re.compile(r"<(think|thinking|reasoning)>.*?(</\1>|$)|</?[A-Za-z][^<>\n]*>|<!--.*?-->", re.S | re.I)
_FENCED = re.compile(r"```.*?(?:```|$)", re.S)
_WORD = re.compile(r"[^\W_]+", re.U)
_HAN, _KANA = re.compile(r"[㐀-鿿豈-﫿]"), re.compile(r"[぀-ヿ]")
_CJK_RUN = re.compile(r"[\u3040-\u30ff\u3400-\u9fff]+")
_ACCENT, _MARK = re.compile("[\u0300-\u036f]+"), re.compile(r"[\W_]+")
#: Marks and blanks of ASCII as blanks.
_BLANKS = str.maketrans({c: " " for c in map(chr, range(128)) if not c.isalnum()})
#: Addresses and identifiers, and what stands in brackets or quotes without an end of a sentence in it.
_JOINED = re.compile(r"https?://\S+|\b_*+[^\W_]++[_/\\.:]\w[\w/\\.:-]*")
_ASIDE = re.compile(r"[(（][^()（）.!?。！？\n]*[)）]|[\"“«「][^\"“”«»「」.!?。！？\n]*[\"”»」]")
_JOINT, _OPENER = re.compile(r"[_/\\.:]\w"), re.compile(r"[(（\"“«「]")
_TICKED = re.compile(r"`[^`\n]*`")
_STOP = ".。!！?？…"
_CLOSERS = "\"'”’»›」』）)]】*_~`"
_SENTENCE = re.compile(r"[.!?…]+[\"'”’»)\]]*(?=\s|$)|[。！？]+[」』）]*|\n+")
_OPEN_CLOSE = (("(", ")"), ("（", "）"), ("[", "]"), ("「", "」"), ("『", "』"), ("“", "”"), ("«", "»"), ("{", "}"))

_FUNCTION = {lang: set(words.split()) for lang, words in P.FUNCTION_WORDS.items()}
#: Items of a gram.
GRAM = 5
#: A word of several languages speaks a little for each.
_SPEAKS = {w: [x for x, known in _FUNCTION.items() if w in known] for w in set().union(*_FUNCTION.values())}
_NAMES = {name: lang for lang, names in P.LANGUAGE_NAMES.items() for name in names.split()}
_PLACEHOLDERS = set(P.PLACEHOLDERS.split()) | {"no content", "no response", "no output"}
_REFUSAL, _REFUSAL_CJK = (re.compile("|".join(f"(?:{p})" for p in held)) for held in (P.REFUSALS, P.REFUSALS_CJK))
_REFUSAL_WORDS = set(P.REFUSAL_WORDS.split())
_LIST_SIGN, _CLAUSE_END, _ITEM = re.compile(r"^[-*>#\s]+"), re.compile(r"[;；]"), re.compile(r"^\s*[-*•+]\s")
_AFTER = re.compile("|".join(f"(?:{p})" for p in P.AFTER_REFUSAL))
_FRAME = re.compile("^(?:" + "|".join(P.ECHO_FRAMES) + ") ?")
_OPENING = re.compile("^(?:" + "|".join(P.OPENINGS) + ")$")


def fold(text: str) -> str:
    """Lower case, compatibility forms, no accents, marks as blanks; kana keep their marks."""
    if text.isascii():
        return " ".join(text.lower().translate(_BLANKS).split())
    plain = _ACCENT.sub("", unicodedata.normalize("NFKD", text.lower()))
    return _MARK.sub(" ", unicodedata.normalize("NFC", plain)).strip()


def bare(text: str | None) -> str:
    """The text without reasoning blocks, markup tags, hidden characters and outer blanks."""
    text = text or ""
    if "<" in text:
        text = _TAGS.sub(" ", text)
    return (text if text.isascii() else _HIDDEN.sub("", text)).strip()


def prose(text: str) -> str:
    """What of a text has a language: no code, tables, identifiers or addresses."""
    if "`" in text:
        text = _TICKED.sub(" ", _FENCED.sub("\n", text))
    if "|" in text:
        text = "\n".join(x for x in text.split("\n") if not x.lstrip().startswith("|"))
    if _JOINT.search(text):
        text = _JOINED.sub(" ", text)
    return _ASIDE.sub(" ", text) if _OPENER.search(text) else text


def is_empty(answer: str | None) -> bool:
    text = bare(answer)
    if not _WORD.search(text):
        return True
    words = fold(text)
    return words in _PLACEHOLDERS or all(w in _PLACEHOLDERS for w in words.split())


def _each_sentence(text: str) -> Iterator[str]:
    at = 0
    for m in _SENTENCE.finditer(text):
        if _WORD.search(text, at, m.end()):
            yield text[at : m.end()]
        at = m.end()
    if _WORD.search(text, at):
        yield text[at:]


def _sentences(text: str) -> list[str]:
    return list(_each_sentence(text))


def _without_opening(sentence: str) -> str:
    """A sentence without a short lead such as "In short:"."""
    head, colon, rest = sentence.partition(":") if ":" in sentence[:40] else sentence.partition("：")
    return rest if colon and len(head) <= 40 and _WORD.search(rest) else sentence


def _declines(words: str) -> bool:
    """Whether a folded sentence declines."""
    if not _REFUSAL_WORDS.isdisjoint(words.split()) and _REFUSAL.search(words):
        return True
    return not words.isascii() and bool(_REFUSAL_CJK.search(words))


def is_refusal(answer: str) -> bool:
    """Every sentence declines or goes with declining; at least one declines. It stops at the first one that does neither."""
    declined, seen = False, set()
    for s in _each_sentence(_LIST_SIGN.sub("", answer)):
        for part in _CLAUSE_END.split(s):
            if part in seen:
                continue
            seen.add(part)
            forms = {fold(part), fold(_without_opening(part))} - {""}
            if any(map(_declines, forms)):
                declined = True
            elif forms and not any(_AFTER.match(x) for x in forms):
                return False
    return declined


def _tight(text: str) -> str:
    return fold(text).replace(" ", "")


def _distance(a, b) -> int:
    """Least number of single edits from a to b; the rows of the table are the bits of whole numbers."""
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    top, full = 1 << (len(a) - 1), (1 << len(a)) - 1
    plus, minus, score = full, 0, len(a)
    for y in b:
        eq = at.get(y, 0)
        x = eq | minus
        d = (((x & plus) + plus) ^ plus) | x
        up, down = minus | ~(d | plus), plus & d
        if up & top:
            score += 1
        if down & top:
            score -= 1
        up = up << 1 | 1
        plus, minus = (down << 1 | ~(x | up)) & full, up & x & full
    return score


def _near(a, b, most: int) -> bool:
    """Whether b comes from a by at most so many single edits.

    An edit destroys at most GRAM grams, so texts that share too few of them are told apart without the table.
    """
    if abs(len(a) - len(b)) > most:
        return False
    if a == b:
        return True
    if not a or not b:
        return max(len(a), len(b)) <= most
    grams = lambda x: Counter(zip(*(x[i:] for i in range(GRAM))))
    need = max(len(a), len(b)) - GRAM + 1 - GRAM * most
    if need > 0 and (grams(a) & grams(b)).total() < need:
        return False
    return _distance(a, b) <= most


def is_echo(question: str | None, answer: str) -> bool:
    """The answer is the question, or its first or last sentence, perhaps framed, quoted, slightly altered or repeated."""
    asked = bare(question)
    q, a = fold(asked), fold(answer)
    if not q or not a:
        return False
    forms = {q.replace(" ", "")}
    parts = _sentences(asked)
    if len(parts) > 1:
        forms |= {_tight(parts[-1]), _tight(parts[0])}
    if (lead := _without_opening(asked)) != asked:
        forms.add(_tight(lead))
    tries = {a, fold(_without_opening(answer))}
    for text in list(tries):
        if m := _FRAME.match(text):
            tries.add(text[m.end() :])
    said, words_q = asked.split(), q.split()
    # One word left out, added or replaced; a word may be one between blanks, such as "reste-t-il".
    if len(said) >= 4 and abs(len(answer.split()) - len(said)) <= 1:
        if _near([_tight(w) for w in answer.split()], [_tight(w) for w in said], 1):
            return True
    for text in tries:
        words = text.split()
        if len(words_q) >= 4 and abs(len(words) - len(words_q)) <= 1 and _near(words, words_q, 1):
            return True
        tight = text.replace(" ", "")
        for form in forms:
            if len(form) < 4:
                continue
            if len(tight) > len(form) and len(tight) % len(form) == 0 and tight == form * (len(tight) // len(form)):
                return True  # given back several times
            if _near(tight, form, max(2, len(form) // 10) if len(form) >= 8 else 0):
                return True
    return False


def evidence(text: str) -> dict[str, float]:
    """How much speaks for each language in a prose text: script, function words and letters."""
    plain = text.isascii()
    kana, han = (0, 0) if plain else (len(_KANA.findall(text)), len(_HAN.findall(text)))
    words = fold(_CJK_RUN.sub(" ", text) if kana + han else text).split()
    if kana + han >= 4 and kana + han >= len(words):
        return {"ja" if kana * 8 > kana + han else "zh": float(kana + han)}
    got = dict.fromkeys(_FUNCTION, 0.0)
    for w in words:
        for lang in _SPEAKS.get(w, ()):
            got[lang] += 1 / len(_SPEAKS[w])
    if plain:
        return got
    low = unicodedata.normalize("NFC", text.lower())
    for lang, (strong, much, weak, little) in P.LETTERS.items():
        got[lang] += min(6, much * sum(map(low.count, strong))) + min(2, little * sum(map(low.count, weak)))
    return got


def language(text: str) -> str | None:
    """The language that most speaks for; None if too little does."""
    got = evidence(text)
    first, *others = sorted(got.values(), reverse=True)
    if first < 1.5 or (others and others[0] == first):
        return None
    return max(got, key=got.get)


def asked_language(question: str) -> set[str]:
    """Languages that the question names."""
    words = fold(question)
    return {lang for name, lang in _NAMES.items() if (name in words if _HAN.search(name) else re.search(rf"\b{name}\b", words))}


def is_other_language(question: str | None, answer: str) -> bool:
    """The answer but for an opening phrase is in another language than the question."""
    asked = evidence(prose(bare(question)))
    ql = max(asked, key=asked.get)
    if asked[ql] < 1:
        return False
    sentences = [s for s in _sentences(prose(answer)) if len(fold(s)) >= 4]
    # An opening says a common phrase, or is no more than half as long as what follows.
    if len(sentences) > 1 and (_OPENING.match(fold(sentences[0])) or 2 * len(sentences[0]) <= sum(map(len, sentences[1:]))):
        sentences = sentences[1:]
    body = [_without_opening(s) for s in sentences]
    al = language(" ".join(body)) if body else None
    # The question must speak clearly less for the answer's language than for its own.
    if al is None or al == ql or 2 * asked.get(al, 0.0) > asked[ql] or asked_language(bare(question)) - {ql}:
        return False
    # The greater part must be in it, sentence by sentence.
    size = {True: 0, False: 0}
    for s in body:
        if (sl := language(s)) is not None:
            size[sl != ql] += len(s)
    return size[True] > 3 * size[False]


def is_cut(answer: str, status: str | None, reason: str | None, error: str | None = None) -> bool:
    """The answer stops before its end: the state or an error says so, a delimiter is open, or the ending is abrupt."""
    if status in CUT_STATUS or reason in CUT_REASON or (error or "").strip():
        return True
    text = answer.rstrip()
    if text.count("```") % 2:
        return True
    lines = text.split("\n")
    tail = lines[-1].strip()
    if tail.endswith("```"):
        return False
    if tail.startswith("|") or (len(lines) > 1 and lines[-2].lstrip().startswith("|")):
        rows = [x for x in lines if x.lstrip().startswith("|")]
        short = tail.startswith("|") and tail.count("|") < rows[0].count("|")
        return short or not tail.endswith("|") and not tail.endswith(tuple(_STOP))
    tail = re.sub(r"[^\w\s.。!！?？…,，、;；:：()（）\[\]{}\"'“”‘’«»‹›「」『』】*_~`/\\|+=&%$€£#@<>-]+\s*$", "", tail).rstrip() or tail
    for opened, closed in _OPEN_CLOSE:
        if tail.count(opened) > tail.count(closed):
            return True
    inner = tail.rstrip(_CLOSERS + " ")
    if _ITEM.match(lines[-1]):
        return not _WORD.search(tail[1:]) or bool(inner) and inner[-1] in ",，、;；:："
    if not inner or inner[-1] in _STOP:
        return False
    if tail[-1] in "🙂":
        return False
    # A short line of its own, such as a number or a name, needs no full stop.
    return not (len(lines) == 1 and len(fold(text)) <= 12 and inner[-1] not in ",，、;；:：")


def defects(question: str | None, answer: str | None, status: str | None, reason: str | None, error: str | None = None) -> list[str]:
    """All defects of a pair in the order of DEFECTS. Nulls count as empty texts.

    An empty answer declines nothing, gives nothing back and has no language, but its state may say that it was cut off.
    """
    if is_empty(answer):
        return ["empty", *(["truncated"] if is_cut("", status, reason, error) else [])]
    text = bare(answer)
    got = []
    if is_refusal(text):
        got.append("refusal")
    if is_echo(question, text):
        got.append("echo")
    if is_other_language(question, text):
        got.append("other_language")
    if is_cut(text, status, reason, error):
        got.append("truncated")
    return got


SCHEMA = "turn_id string, defects array<string>"


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        got = [
            defects(*x) for x in zip(b["question"], b["answer"], b["status"], b["reason"], b["error"])
        ]
        yield pd.DataFrame({"turn_id": b["turn_id"], "defects": got})[[bool(g) for g in got]]


def flag_pairs(pairs: DataFrame) -> DataFrame:
    """(turn_id, defects): the pairs with at least one defect.

    pairs: (turn_id, question, answer, status, reason, error), any of them null: a null answer is an empty
    one, a null question has no language and nothing to give back. Repeated rows give repeated
    results, other columns are ignored, texts of any length are judged whole. Empty input gives none.
    """
    return pairs.select("turn_id", "question", "answer", "status", "reason", "error").mapInPandas(_rows, SCHEMA)
