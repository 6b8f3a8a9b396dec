"""Text functions on columns, JVM-side but for the few that Spark has no expression for."""

from __future__ import annotations

import unicodedata
import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters, digits and underscore of any script.
WORD = r"[\p{L}\p{N}_]+"
#: Latin and Russian letters and ASCII digits.
PLAIN_WORD = r"[A-Za-zА-Яа-яЁё0-9]+"
NUMBER = r"\d+(?:[.,]\d+)?"
CHUNK = r"\[CHUNK\s+\d+\]"
SPACES = r"[ \t\n\x0B\f\r]+"
#: Roles that open a turn in a written dialog; fixed values.
CLIENT, ROLES = "Клиент", ("Клиент", "Ассистент", "Оператор")

#: Russian function words that don't count as content; fixed values.
STOPWORDS = (
    "а", "без", "более", "бы", "был", "была", "были", "было", "быть", "в", "вам", "вас", "весь", "во", "вот", "все", "всего", "вы", "где", "да",
    "для", "до", "его", "ее", "если", "есть", "ещё", "же", "за", "и", "из", "или", "их", "к", "как", "когда", "который", "ли", "на", "над",
    "не", "но", "о", "об", "он", "она", "они", "от", "по", "под", "при", "с", "со", "так", "также", "то", "у", "уже", "что",
    "чтобы", "это", "этот", "я",
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACES}|{SPACES}$", "")


def collapse(text: Column) -> Column:
    return strip(F.regexp_replace(text, SPACES, " "))


def normalise(text: Column) -> Column:
    """Lower case, one space between words, none around."""
    return collapse(F.lower(text))


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None else unicodedata.normalize("NFKC", t))


def query_key(text: Column) -> Column:
    """NFKC, lower case, punctuation to spaces, spaces collapsed; idempotent."""
    return collapse(F.regexp_replace(F.lower(nfkc(text)), r"[^\p{L}\p{N}_\s]", " "))


def tokens(text: Column, pattern: str = WORD) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def content_tokens(text: Column) -> Column:
    """Distinct plain words longer than two letters that are no function words."""
    return F.array_except(F.filter(tokens(text, PLAIN_WORD), lambda t: F.length(t) > 2), F.array(*[F.lit(w) for w in STOPWORDS]))


def long_tokens(text: Column, least: int = 4) -> Column:
    return F.array_distinct(F.filter(tokens(text), lambda t: F.length(t) >= least))


def chunks(context: Column) -> Column:
    """Parts between chunk marks that hold text; an unmarked context is one part, a blank one none."""
    parts = F.filter(F.transform(F.split(context, CHUNK), strip), lambda p: p != "")
    return let(parts, lambda ps: F.when(F.size(ps) > 0, ps).when(strip(context) != "", F.array(context)).otherwise(F.array().cast("array<string>")))


def numbered_chunks(context: Column, mark: str = r"\[(?:CHUNK|ЧАНК|ФРАГМЕНТ)\s+(\d+)\]") -> Column:
    """array<struct<number, text>>: the printed number of each chunk and its text; text before the first mark goes."""
    numbers = F.transform(F.regexp_extract_all(context, F.lit(mark), F.lit(1)), lambda n: n.cast("int"))
    texts = F.transform(F.split(context, mark), strip)
    pairs = F.zip_with(numbers, F.slice(texts, F.lit(2), F.greatest(F.size(texts) - 1, F.lit(0))), lambda n, t: F.struct(n.alias("number"), t.alias("text")))
    return F.filter(pairs, lambda p: p["text"] != "")


def first_chunk_key(context: Column) -> Column:
    """Normalised text of chunk 1; null where there is none."""
    body = F.regexp_extract(context, r"(?s)\[CHUNK 1\](.*?)(?=\[CHUNK \d+\]|\z)", 1)
    return F.nullif(query_key(body), F.lit(""))


def ngrams(words: Column, n: int) -> Column:
    """Runs of n words, space-joined; none where there are fewer words. Shifted copies are zipped, one pass a word of the run."""
    runs = words
    for k in range(1, n):
        rest = F.slice(words, F.lit(k + 1), F.greatest(F.size(words) - k, F.lit(0)))
        runs = F.zip_with(F.slice(runs, F.lit(1), F.size(rest)), rest, lambda a, b: F.concat(a, F.lit(" "), b))
    return runs


def ngram_overlap(a: Column, b: Column, n: int = 2) -> Column:
    """Share of a's runs of n words, repeats counted, that b has; single words where a is shorter; 0 for an empty a.

    What a has and b lacks is found by one hash pass over both, so long contexts cost no product."""

    def share(x: Column, y: Column, k: int) -> Column:
        gs = lambda g: let(F.array_except(g, ngrams(y, k)), lambda lack: F.size(F.filter(g, lambda t: ~F.array_contains(lack, t))) / F.size(g))
        return let(ngrams(x, k), gs)

    return let(tokens(a), lambda x: let(tokens(b), lambda y: F.when(F.size(x) == 0, F.lit(0.0)).when(F.size(x) < n, share(x, y, 1)).otherwise(share(x, y, n))))


def coverage(source: Column, target: Column) -> Column:
    """Share of the target's distinct words that the source has; 0 where the target has none."""
    return let(target, lambda t: F.when(F.size(t) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(t, source)) / F.size(t)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared words over all words; two empty sets are equal."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(both, F.lit(1)))


def numbers(text: Column) -> Column:
    """Numbers as written."""
    return F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))


def plain_number(value: Column) -> Column:
    """Comma to dot, no zeros at a fraction's end."""
    dotted = F.replace(value, F.lit(","), F.lit("."))
    return F.when(F.contains(dotted, F.lit(".")), F.regexp_replace(dotted, r"\.?0+$", "")).otherwise(dotted)


def grouped_numbers(text: Column) -> Column:
    """Distinct numbers with grouped thousands joined, as doubles of six significant digits."""
    raw = F.regexp_extract_all(text, F.lit(r"\d{1,3}(?:[\s ]\d{3})+|\d+(?:[.,]\d+)?"), F.lit(0))
    return F.array_distinct(F.transform(raw, lambda n: six_digits(F.replace(F.regexp_replace(n, r"[\s ]", ""), F.lit(","), F.lit(".")).cast("double"))))


def six_digits(x: Column) -> Column:
    """x rounded to six significant digits."""
    scale = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(x))) - 5)
    return F.when(x == 0, x).otherwise(F.round(F.bround(x / scale) * scale, 12))


def digit_match(answer: Column, context: Column) -> Column:
    """Share of the answer's numbers, repeats counted, that the context has; 1 where it has none."""
    a, c = F.transform(numbers(answer), plain_number), F.transform(numbers(context), plain_number)
    return let(a, lambda x: F.when(F.size(x) == 0, F.lit(1.0)).otherwise(let(F.array_except(x, c), lambda lack: F.size(F.filter(x, lambda n: ~F.array_contains(lack, n))) / F.size(x))))


def number_support(context: Column, answer: Column, dotted: bool = False) -> Column:
    """Share of the answer's distinct numbers that the context has; 1 where it has none."""
    form = (lambda n: F.replace(n, F.lit(","), F.lit("."))) if dotted else (lambda n: n)
    a, c = F.array_distinct(F.transform(numbers(answer), form)), F.transform(numbers(context), form)
    return let(a, lambda x: F.when(F.size(x) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(x, c)) / F.size(x)))


def contains_any(text: Column, phrases: Sequence[str]) -> Column:
    return F.exists(F.array(*[F.lit(p.lower()) for p in phrases]), lambda p: F.contains(F.lower(text), p))


def last_client_turn(dialog: Column, roles: Sequence[str] = ROLES) -> Column:
    """Text of the last turn of the client in a written dialog; null without one. Names of assistants that open a turn
    are given with the roles."""
    turns = F.regexp_extract_all(dialog, F.lit(rf"(?ms)^{CLIENT}\s*:[ \t]*(.*?)(?=^(?:{'|'.join(map(re.escape, roles))})\s*:|\z)"), F.lit(1))
    return strip(F.try_element_at(turns, F.lit(-1)))


def sentences(text: Column) -> Column:
    """Parts that end in . ! ? or … before white space, or at a line's end; a blank text is one part."""
    parts = F.filter(F.transform(F.split(text, r"(?<=[.!?…])\s+|\n+"), strip), lambda s: s != "")
    return let(parts, lambda ps: F.when(F.size(ps) > 0, ps).otherwise(F.array(text)))


def truncated(text: Column, most: int, suffix: str = "") -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(suffix))).otherwise(text)


def filled(template: str, values: Sequence[tuple[str, Column]]) -> Column:
    """The template with {name} replaced by each value in turn; a value's own braces may be replaced by a later one."""
    out = F.lit(template)
    for name, value in values:
        out = F.replace(out, F.lit(f"{{{name}}}"), value)
    return out


def verdict(text: Column, axis: str) -> Column:
    """1, 0 or null: the last `AXIS: PASS|FAIL` in the text."""
    last = F.try_element_at(F.regexp_extract_all(text, F.lit(rf"(?i){axis}\s*:\s*(PASS|FAIL)"), F.lit(1)), F.lit(-1))
    return F.when(F.upper(last) == "PASS", 1).when(F.upper(last) == "FAIL", 0)


def first_json(text: str | None) -> str | None:
    """The first balanced {...} that parses as JSON; braces inside strings are braces."""
    import json

    text = text or ""
    start = text.find("{")
    while start >= 0:
        depth = 0
        for end in range(start, len(text)):
            depth += (text[end] == "{") - (text[end] == "}")
            if depth == 0:
                try:
                    json.loads(text[start : end + 1])
                    return text[start : end + 1]
                except ValueError:
                    break
        start = text.find("{", start + 1)
    return None


@F.pandas_udf(T.StringType())
def json_object(texts: pd.Series) -> pd.Series:
    return texts.map(first_json)


def last_path_part(path: Column, back: int) -> Column:
    return F.try_element_at(F.split(path, "/"), F.lit(-back))


def latest_question(dialog: Column) -> Column:
    """The last turn after a client or user label in any case; the whole text, stripped, where no label is."""
    label = "Клиент|Пользователь|User|Client"
    turns = F.regexp_extract_all(dialog, F.lit(rf"(?isu)(?:{label})\s*:\s*(.+?)(?=(?:Ассистент|Assistant|{label})\s*:|\z)"), F.lit(1))
    said = F.filter(F.transform(turns, strip), lambda x: x != "")
    return F.coalesce(F.try_element_at(said, F.lit(-1)), strip(dialog))
