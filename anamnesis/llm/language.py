"""The language of every text and of every stretch in another language.

A text is cut into sentences; code, tables, log lines, addresses, names of speakers, quoted or
bracketed words and lines shorter than a sentence have no language. A byte CNN gives each sentence
its class probabilities, from the mean of its windows, and is cut where its windows change their
language for more than a passing word, as in dictated memos without full stops. Neighbouring
sentences of one language make one segment.

The network is trained on the driver from a bounded sample of labelled texts, as labels are often
wrong: it is fitted once to all sampled sentences, drops those that it then puts in another
language than their text's label, and is fitted again to the rest.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anamnesis.llm.byte_cnn import LENGTH, ByteCNN, windows
from anamnesis.session import spread

LANGUAGES = ("de", "en", "es", "fr", "ja", "nl", "pt", "zh")
#: Codes and names of the languages, folded to lower case without accents. Fixed values.
NOTATIONS = {
    "de": "de deu ger german deutsch allemand aleman duits alemao",
    "en": "en eng english englisch anglais ingles engels inglese",
    "es": "es spa esp spanish castilian spanisch espagnol espanol castellano spaans espanhol",
    "fr": "fr fra fre french franzosisch francais frances frans",
    "ja": "ja jpn jp japanese japanisch japonais japones japans 日本語 日语 日文",
    "nl": "nl nld dut dutch flemish niederlandisch neerlandais holandes neerlandes nederlands vlaams",
    "pt": "pt por portuguese portugiesisch portugais portugues portugees",
    "zh": "zh zho chi cmn cn chinese mandarin chinesisch chinois chino chinees chines 中文 汉语 漢語 华语 普通话",
}
#: What says that no single language is named.
NO_LANGUAGE = "und mul mis zxx xx xxx unknown unk none null na n/a ? - -- other auto multiple mixed undefined undetermined"

#: Bounds of the training sample: texts per label and sentences per text.
TEXTS_PER_LABEL = 250
SENTENCES_PER_TEXT = 8
STEPS = (250, 700)
#: Least confidence of a sentence, and of one whose language no other sentence of the text has.
LEAST, LEAST_ALONE = 0.6, 0.9


def label_language(label: Column) -> Column:
    """The language a label names: one of LANGUAGES, "other", or null where it names no single one."""
    tidy = F.translate(F.lower(F.trim(label)), "áàâãäéèêëíìîïóòôõöúùûüçñ", "aaaaaeeeeiiiiooooouuuucn")
    known = {w: k for k, words in NOTATIONS.items() for w in words.split()}
    table = F.create_map(*[F.lit(x) for kv in sorted(known.items()) for x in kv])
    head = F.regexp_extract(tidy, r"^([^\s_\-(@.]+)(?:[_\-.@][a-z0-9]+)*\s*(?:\(.*\))?$", 1)
    head = F.when(head == "", F.regexp_extract(tidy, r"^(\S+) +(?:simplified|traditional|us|uk|gb|br|language|简体|繁體).*$", 1)).otherwise(head)
    whole = F.coalesce(F.try_element_at(table, tidy), F.try_element_at(table, head))
    vague = tidy.isin(*NO_LANGUAGE.split()) | head.isin(*NO_LANGUAGE.split())
    return F.when(whole.isNotNull(), whole).when(~vague & head.rlike(r"^[a-z]{2,12}$"), "other")


_FENCE = re.compile(r"```.*?(?:```|\Z)|<(code|pre)>.*?(?:</\1>|\Z)", re.S)
_LINE = re.compile(r"[^\n\r]+")
_LEAD = re.compile(r"\s*(?:[>#*\-+•|]+\s*|\(?\d{1,3}[.)、]\s+|\[[ xX]\]\s*)*(?:[\w .’'-]{1,24}(?:: |：\s*))?")
_STOP = re.compile(r"[.!?…。！？](?:(?<=[.!?…])[.!?…]*[\"'”’»)\]]*(?=\s|$)|(?<=[。！？!?])[。！？!?]*[」』”’）)]*)")
#: Words in brackets or quotes, if no sentence ends in them, addresses, identifiers and numbers.
_ASIDE = re.compile(
    r"[(（\[【][^()（）\[\]【】.!?。！？]*[)）\]】]|[\"“«「『‘][^\"”»」』’.!?。！？]+[\"”»」』’]|`[^`]*`|https?://\S+|\S+@\S+"
    r"|[A-Za-z0-9$%./\\_-]*[A-Za-z0-9$%][_=./\\:][A-Za-z0-9$%][A-Za-z0-9$%_=./\\:-]*|(?<![A-Za-z0-9])[A-Za-z]*\d[A-Za-z0-9]*"
)
#: What a sentence with an aside has somewhere.
_MARKED = re.compile(r"[(（\[【\"“«「『‘`@\d]|[A-Za-z0-9$%][_=./\\:][A-Za-z0-9$%/]")
_WORD = re.compile(r"[^\W\d_]+")
_CJK = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]")
_CODE = re.compile(r"[{}=;<>|\\$^~`*/\[\]()_]")
_STOPS = tuple(".!?…。！？")


def _clean(text: str) -> str:
    return " ".join((_ASIDE.sub(" ", text) if _MARKED.search(text) else text).split())


def sentences(text: str) -> list[tuple[int, int, str]]:
    """(start, end, text without asides) of every whole sentence that can have a language."""
    hidden = [m.span() for m in _FENCE.finditer(text)] if "```" in text or "<" in text else []
    got, fence = [], 0
    for line in _LINE.finditer(text):
        a, b = line.span()
        while fence < len(hidden) and hidden[fence][1] <= a:
            fence += 1
        if (fence < len(hidden) and hidden[fence][0] < b) or text.count("|", a, b) >= 2:
            continue
        lead = _LEAD.match(text, a, b).end()
        heading = text[a:lead].lstrip().startswith("#")
        at = lead
        for end in [*(m.end() for m in _STOP.finditer(text, lead, b)), b]:
            if end <= at:
                continue
            raw = text[at:end]
            words = _clean(raw)
            cjk = 0 if words.isascii() else len(_CJK.findall(words))
            latin = len(_WORD.findall(words)) if not cjk else len([w for w in _WORD.findall(words) if not _CJK.search(w)])
            stopped = raw.rstrip().rstrip("\"'”’»)]」』）").endswith(_STOPS)
            enough = cjk >= 5 or latin >= 3 if stopped and not heading else cjk >= 14 or latin >= 7
            if enough and (not _CODE.search(words) or len(_CODE.findall(words)) * 8 <= len(words)):
                got.append((at, end, words))
            at = end
    return got


def _bytes(text: str) -> bytes:
    """What the network sees: lower case, numbers left out, one blank between words."""
    return f" {text.lower()} ".encode("utf-8", "ignore")


def _plain(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not "̀" <= c <= "ͯ")


def train(sample: list[tuple[str, str]]) -> ByteCNN:
    """A network from (sentence, label) pairs; labels outside LANGUAGES are left out, nothing gives an untrained one."""
    sample = sorted((s, x) for s, x in sample if x in LANGUAGES)
    texts, labels = [_bytes(s) for s, _ in sample], np.array([LANGUAGES.index(x) for _, x in sample], np.int64)
    net = ByteCNN(LANGUAGES)
    if not texts:
        return net
    net.fit(texts, labels, STEPS[0])
    x, owner = windows(texts, LENGTH)
    p = np.zeros((len(texts), len(LANGUAGES)))
    np.add.at(p, owner, net.probabilities(x))
    agrees = p.argmax(1) == labels
    texts, labels = [t for t, ok in zip(texts, agrees) if ok], labels[agrees]
    # Some texts are written without accents: one sentence in five is shown so as well.
    bare = [i for i in range(0, len(texts), 5) if labels[i] not in (LANGUAGES.index("ja"), LANGUAGES.index("zh"))]
    texts += [_plain(texts[i].decode()).encode() for i in bare]
    net.fit(texts, np.concatenate([labels, labels[bare]]), STEPS[1], seed=12)
    return net


def _sampled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for text, label in zip(b["text"], b["label"]):
            s = sentences(text)
            step = max(1, len(s) // SENTENCES_PER_TEXT)
            out += [(x[2][: 8 * LENGTH], label) for x in s[::step][:SENTENCES_PER_TEXT]]
        yield pd.DataFrame(out, columns=["sentence", "label"])


def fit(docs: DataFrame) -> ByteCNN:
    """Train on a sample of (doc_id, text, lang): TEXTS_PER_LABEL texts of each named language by the hash of the id."""
    labelled = docs.select("doc_id", "text", label_language(F.col("lang")).alias("label")).where(
        F.col("label").isin(*LANGUAGES) & (F.char_length("text") > 0)
    )
    ids = labelled.select("doc_id", "label").withColumn("_h", F.xxhash64("doc_id"))
    w = Window.partitionBy("label").orderBy("_h", "doc_id")
    picked = ids.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= TEXTS_PER_LABEL).select("doc_id")
    # At most TEXTS_PER_LABEL ids of each language: small enough to broadcast, so no text is shuffled.
    chosen = labelled.join(F.broadcast(picked), "doc_id", "left_semi").select("doc_id", "text", "label")
    chosen = chosen.repartition(docs.sparkSession.sparkContext.defaultParallelism, "doc_id")
    rows = chosen.mapInPandas(_sampled, "sentence string, label string")
    return train([(r[0], r[1]) for r in rows.collect()])


def _runs(p: np.ndarray, start: int, end: int) -> list[tuple[int, int, int, float]]:
    """Runs of windows of one language within a sentence as (start, end, class, confidence)."""
    smooth = p.copy()
    smooth[1:-1] = (p[:-2] + 2 * p[1:-1] + p[2:]) / 4
    lab = smooth.argmax(1)
    cuts = np.flatnonzero(np.diff(lab)) + 1
    got = []
    for a, b in zip([0, *cuts], [*cuts, len(lab)]):
        share = lambda i: start + (end - start) * i // len(lab)
        got.append((share(a), share(b), int(lab[a]), float(p[a:b, lab[a]].mean()), b - a))
    # A run of one window is a passing word, not a sentence.
    kept = [g[:4] for g in got if g[4] >= 2]
    return kept or [(start, end, int(p.mean(0).argmax()), float(p.mean(0).max()))]


def classify(net: ByteCNN, texts: list[str]) -> list[list[tuple[int, int, str, float]]]:
    """Segments (start, end, language, confidence) of each text, in order."""
    found = [sentences(t) if t else [] for t in texts]
    # Each distinct sentence goes through the network once.
    distinct = {w: k for k, w in enumerate(dict.fromkeys(w for xs in found for _, _, w in xs))}
    x, owner = windows([_bytes(w) for w in distinct], LENGTH)
    p = net.probabilities(x)
    begins = np.searchsorted(owner, np.arange(len(distinct)))
    ends = [*begins[1:].tolist(), len(owner)]
    # A sentence whose windows agree is one run; the others are looked at one by one.
    best = p.argmax(1)
    agree = np.minimum.reduceat(best, begins) == np.maximum.reduceat(best, begins) if len(distinct) else begins
    first = best[begins].tolist() if len(distinct) else []
    mean = (np.add.reduceat(p[np.arange(len(p)), best], begins) / np.diff([*begins, len(owner)])).tolist() if len(distinct) else []
    begins, agree = begins.tolist(), agree.tolist()
    got: list[list[tuple]] = [[] for _ in texts]
    for mine, xs in zip(got, found):
        for s, e, w in xs:
            k = distinct[w]
            if agree[k]:
                mine.append((s, e, first[k], mean[k]))
            else:
                mine += _runs(p[begins[k] : ends[k]], s, e)
    return [_joined(sorted(g)) for g in got]


def _joined(found: list[tuple[int, int, int, float]]) -> list[tuple[int, int, str, float]]:
    """Drop what is not sure, join neighbours of one language; the confidence of a segment is weighted by length."""
    times = np.bincount([f[2] for f in found if f[3] >= LEAST], minlength=len(LANGUAGES)) if found else []
    got: list[list] = []
    for s, e, c, p in found:
        if p < LEAST or (p < LEAST_ALONE and times[c] == 1 and len(found) > 1):
            continue
        if got and got[-1][2] == LANGUAGES[c]:
            n, m = got[-1][1] - got[-1][0], e - s
            got[-1][3] = (got[-1][3] * n + p * m) / (n + m)
            got[-1][1] = e
        else:
            got.append([s, e, LANGUAGES[c], p])
    return [tuple(g) for g in got]


SEGMENT = "doc_id long, lang string, start_char int, end_char int, lang_found string, confidence double"


def segments(docs: DataFrame, net: ByteCNN) -> DataFrame:
    """(doc_id, lang, start_char, end_char, lang_found, confidence) of every segment with a language.

    docs: (doc_id, text, lang). Null and empty texts and texts without language give no rows; repeated
    rows give their segments again. Offsets are in code points, half-open.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in SEGMENT.split(", ")]
        for b in batches:
            for i in range(0, len(b), 256):
                part = b.iloc[i : i + 256]
                found = classify(net, part["text"].tolist())
                out = [
                    (d, lab, s, e, x, p)
                    for d, lab, f in zip(part["doc_id"], part["lang"], found)
                    for s, e, x, p in f
                ]
                if out:
                    yield pd.DataFrame(out, columns=names)

    return spread(docs.select("doc_id", "text", "lang").where(F.char_length("text") > 0), "doc_id").mapInPandas(rows, SEGMENT)
