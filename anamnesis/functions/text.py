"""Text columns: tokens, normal forms, clauses and passages, all in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The reference's six ranges of characters that are written without blanks between words.
CJK = r"\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\u3040-\u30ff\uac00-\ud7af"
_WORD, _CHAR = rf"[\p{{L}}\p{{N}}&&[^{CJK}]]+", rf"[\p{{L}}\p{{N}}&&[{CJK}]]"
#: Marks that end a clause, and clauses that assert nothing.
ENDS = r"[.。!！?？;；\r\n]"
GREETINGS = ("hi", "hello", "hey", "thanks", "thank you", "ok", "okay", "你好", "谢谢", "好的", "hallo", "danke", "hola", "gracias", "bonjour", "merci", "olá", "obrigado", "こんにちは", "ありがとう")
WINDOW, STEP = 240, 200


def tokens(text: Column) -> Column:
    """Words, and the 2- and 3-grams of each CJK run; a run of one character is a token. Repeats are kept, null gives null.

    Grams are found by lookahead, one scan for each length, so that a text that is one long run costs no more than another.
    """
    found = lambda pattern, group: F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(group))
    single = rf"(?<!{_CHAR}){_CHAR}(?!{_CHAR})"
    return F.concat(found(rf"{_WORD}|{single}", 0), found(rf"(?=({_CHAR}{{2}}))", 1), found(rf"(?=({_CHAR}{{3}}))", 1))


def mixed_tokens(text: Column) -> Column:
    """The reference's tokens of answers: words, and each CJK character for itself."""
    return F.regexp_extract_all(F.lower(text), F.lit(rf"[{CJK}]|{_WORD}"), F.lit(0))


def normal_answer(text: Column) -> Column:
    """Lower case, ASCII marks as blanks, no articles, single blanks."""
    plain = F.regexp_replace(F.lower(text), r"[!-/:-@\[-`{-~]", " ")
    words = F.filter(F.split(plain, r"\s+"), lambda w: ~w.isin("a", "an", "the", ""))
    return F.array_join(words, " ")


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def title(text: Column) -> Column:
    """The first 40 characters of the collapsed text, and an ellipsis where more follow."""
    t = collapsed(text)
    return F.when(F.char_length(t) > 40, F.concat(F.substring(t, 1, 40), F.lit("…"))).otherwise(t)


def raw_clauses(text: Column) -> Column:
    """array<string> of stretches up to and with each ending mark; together they are the text."""
    return F.regexp_extract_all(text, F.lit(rf"[^.。!！?？;；\r\n]*{ENDS}|[^.。!！?？;；\r\n]+$"), F.lit(0))


def window_starts(length: Column) -> Column:
    """Starts of sliding windows over a text longer than WINDOW; the last window ends at its end."""
    last = length - WINDOW
    regular = F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(STEP)), lambda s: s < last)
    return F.when(length > WINDOW, F.concat(regular, F.array(last)))
