"""What a prompt's author is told about a judge's verdict on one case."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as t

#: Sentences of the feedback; fixed values.
RIGHT = "Верно."
WRONG = "Ошибка. Правильный ответ: %s=%s."
NO_VERDICT = "Вердикта в выводе не нашлось: строки «%s: PASS» или «%s: FAIL» в ответе нет. Формат вывода обязателен."
KIND = "Тип ошибки: %s."
ANSWER = "Фрагмент ответа: «%s»."
CLOSEST = "ближайший по лексике — чанк %d"
NONE_CLOSE = "ни один чанк лексически не пересекается с этим фрагментом"
UNSUPPORTED = "В чанках это не подтверждается: %s."
SUPPORTED = "Этот фрагмент опирается на [CTX]: %s."
ASKED = "Вопрос клиента: «%s»."
#: Markers that say nothing.
NO_MARKER = ("", "none", "unknown")
#: Marks of chunks, with their numbers.
MARK = r"(?iu)\[(?:CHUNK|ЧАНК|ФРАГМЕНТ)\s*(\d+)\]"
SNIPPET = 240


def snippet(text: Column, most: int = SNIPPET) -> Column:
    """The text in one line, cut after most characters, which an ellipsis shows."""
    return t.let(t.collapse(text), lambda line: F.when(F.length(line) <= most, line).otherwise(F.concat(F.rtrim(F.substring(line, 1, most)), F.lit("…"))))


def closest_chunk(answer: Column, context: Column) -> Column:
    """The printed number of the chunk that shares the most words of four letters or more with the answer, of equals
    the first; null where none shares any or there are no marks."""

    def best(words: Column) -> Column:
        shared = F.transform(t.numbered_chunks(context, MARK), lambda c, i: F.struct(F.size(F.array_intersect(words, t.long_tokens(c["text"]))).alias("n"), (-i).alias("order"), c["number"].alias("number")))
        return F.array_max(F.filter(shared, lambda c: c["n"] > 0))["number"]

    return t.let(t.long_tokens(answer), best)


def feedback(axis: str, gold: Column, pred: Column, answer: Column, context: Column, question: Column, marker: Column | None = None, gloss: Mapping[str, str] | None = None, most: int = SNIPPET) -> Column:
    """One line: that the verdict was right, or the right one, whether none was found, the kind of fault, the answer's
    beginning and the chunk to look at; where there is no context, for RELEVANCE, what the client asked last.

    gold is 0 or 1, pred that or null. Null texts are empty ones; null gold gives null. marker is left out where it
    says nothing, and is named by gloss where that knows it."""
    text = lambda c: F.coalesce(c, F.lit(""))
    answer, context, question = text(answer), text(context), text(question)
    said = [
        F.format_string(WRONG, F.lit(axis), F.when(gold == 1, "PASS").otherwise("FAIL")),
        F.when(pred.isNull(), F.lit(NO_VERDICT % (axis, axis))),
    ]
    if marker is not None:
        named = F.coalesce(F.create_map(*[F.lit(x) for kv in gloss.items() for x in kv])[marker], marker) if gloss else marker
        said.append(F.when(~text(marker).isin(*NO_MARKER), F.format_string(KIND, named)))
    said.append(F.format_string(ANSWER, snippet(answer, most)))
    where = t.let(closest_chunk(answer, context), lambda n: F.when(n.isNotNull(), F.format_string(CLOSEST, n)).otherwise(F.lit(NONE_CLOSE)))
    about = F.when(t.strip(context) != "", F.when(gold == 0, F.format_string(UNSUPPORTED, where)).otherwise(F.format_string(SUPPORTED, where)))
    if axis == "RELEVANCE":
        turn = t.let(text(t.last_client_turn(question)), lambda last: F.when(last != "", last).otherwise(question))
        about = about.when(t.strip(question) != "", F.format_string(ASKED, snippet(turn, most)))
    said.append(about)
    return F.when(gold.isNull(), None).when(pred.eqNullSafe(gold), F.lit(RIGHT)).otherwise(F.concat_ws(" ", *said))
