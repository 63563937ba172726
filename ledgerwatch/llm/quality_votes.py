"""Quality rules under weak supervision, in DataFrame and SQL functions only.

Each rule votes for a text (1), against it (-1) or abstains (0). Texts are good, or bad in one
of a few ways; expectation-maximisation over all texts that pass the base rules estimates the
share of each class and how often each rule is right about it when it votes. A text is kept if
its posterior probability of being good is at least one half. So a vote weighs by what it
tells: two against, from rules that agree on one way of being bad, outweigh many that nearly
all texts get. The votes of m rules make at most 3^m patterns, so the estimation works on
counts of patterns in one row, whatever the number of texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerwatch.llm.common import SPACE, ids_and_texts
from ledgerwatch.session import materialise

_BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"
_MARK = f"[^\\p{{L}}\\p{{M}}\\p{{N}}{SPACE}]"
WINDOW = 5
ROUNDS = 40
#: The ways of being bad, by rules that vote against such texts.
WAYS = (("symbols", "marks"), ("repeated_lines", "repeated_words"), ("capitals", "sentences", "word_length"))
#: Before the first round: share of good texts; how often a rule votes against a good text, a bad one of its
#: way, and another bad one. Bounds of all, and the most that a rule may err on good texts.
GOOD, ON_GOOD, ITS_WAY, OTHER_WAY, LEAST, MOST, MOST_ON_GOOD = 0.85, 0.05, 0.9, 0.15, 0.01, 0.99, 0.5

#: Rule, measure, condition for a vote for, condition for a vote against; otherwise it abstains.
RULES = (
    ("length", "n_words", "x >= 40", "x < 15"),
    ("word_length", "1e0 * word_chars / n_words", "x between 3 and 9", "x < 2.5 or x > 12"),
    ("symbols", "1e0 * n_symbols / n_words", "x <= 0.02", "x > 0.1"),
    ("repeated_lines", "case when n_lines >= 3 then 1e0 * n_dup_lines / n_lines end", "x <= 0.1", "x > 0.3"),
    ("repeated_words", "1e0 * n_repeat_words / n_words", "x <= 0.05", "x > 0.2"),
    ("sentences", "1e0 * n_ends / n_words", "x between 0.02 and 0.4", "x < 0.005"),
    ("marks", "1e0 * n_marks / word_chars", "x <= 0.06", "x > 0.1"),
    ("capitals", "1e0 * n_upper / word_chars", "x <= 0.15", "x > 0.4"),
)

# Windows by two hashes: positions whose window occurs elsewhere, then the words they cover.
_REPEATED = f"""
case when n_words < {WINDOW} or size(array_distinct(hashes)) = size(hashes) then 0L else
  get(transform(array(array_sort(transform(hashes, (h, i) -> struct(h as h, i as i)))), s ->
    get(transform(array(sort_array(transform(filter(sequence(0, size(s) - 1), k ->
        (k > 0 and s[k].h = s[k - 1].h and slice(words, s[k].i + 1, {WINDOW}) = slice(words, s[k - 1].i + 1, {WINDOW}))
        or (k < size(s) - 1 and s[k].h = s[k + 1].h and slice(words, s[k].i + 1, {WINDOW}) = slice(words, s[k + 1].i + 1, {WINDOW}))),
      k -> s[k].i))), p ->
      aggregate(sequence(1, size(p)), 0L, (a, k) -> a + case when k = size(p) then {WINDOW} else least({WINDOW}, p[k] - p[k - 1]) end)), 0)), 0)
end"""


def _without(text: str, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def measures(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Counts of every whole text: ``id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_ends, n_upper, n_marks``.

    Store the result before filtering on it (as ``judged`` does): a pushed-down filter would
    compute the arrays of words anew for each of their elements.

    Words lie between ASCII white space. ``n_lines`` are lines with a word, ``n_dup_lines``
    those equal to an earlier one, ``n_repeat_words`` the words in 5-word windows that occur
    twice or more, ``n_marks`` the characters that are no letters, digits or blanks. Null texts are empty and count 0 everywhere.
    """
    t = ids_and_texts(df, id_col, text_col)
    t = t.withColumn("words", F.expr(f"filter(split(text, '[{SPACE}]+'), w -> w <> '')"))
    t = t.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, _BLANKS, "")) > 0))
    t = t.withColumn("n_words", F.size("words"))
    gets = ", ".join(f"get(words, i + {k})" for k in range(WINDOW))
    t = t.withColumn("hashes", F.expr(f"case when n_words < {WINDOW} then array() else transform(sequence(0, n_words - {WINDOW}), i -> xxhash64({gets})) end"))
    return t.select(
        "id", F.col("n_words").cast("long"),
        F.length(F.translate("text", _BLANKS, "")).cast("long").alias("word_chars"),
        _without("text", SYMBOLS).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(_REPEATED).alias("n_repeat_words"),
        _without("text", ".!?").cast("long").alias("n_ends"),
        _without("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long").alias("n_upper"),
        (F.length("text") - F.length(F.regexp_replace("text", _MARK, ""))).cast("long").alias("n_marks"),
    )


def votes(measured: DataFrame) -> DataFrame:
    """With ``votes``, an array of the rules' votes; a rule without a measure (no words) abstains."""
    def vote(measure: str, good: str, bad: str) -> str:
        found = f"({measure})"
        good, bad = (c.replace("x ", f"{found} ") for c in (good, bad))
        return f"case when n_words = 0 then 0 when {good} then 1 when {bad} then -1 else 0 end"

    return measured.withColumn("votes", F.expr(f"array({', '.join(vote(m, g, b) for _, m, g, b in RULES)})"))


def starting_rates() -> tuple[list[float], list[list[float]]]:
    """Shares of the classes, good texts first, and how often each rule votes against each class."""
    names = [name for name, *_ in RULES]
    return ([GOOD] + [(1 - GOOD) / len(WAYS)] * len(WAYS),
            [[ON_GOOD] * len(names)] + [[ITS_WAY if n in way else OTHER_WAY for n in names] for way in WAYS])


def accuracies(voted: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """One row with ``model``: the classes' shares and each rule's rate of votes against each
    class, after ``rounds`` rounds; a rule is right about good texts one time less that rate.

    Counts of vote patterns are aggregated before and after one shuffle; their number is at
    most 3 to the number of rules. A rate counts only the texts that a rule votes on, and two
    more at the rate it began with.
    """
    m, (shares, rates) = len(RULES), starting_rates()
    classes = len(shares)
    patterns = voted.groupBy("votes").agg(F.count("*").cast("double").alias("n"))
    gathered = patterns.agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("p"))
    listed = lambda xs: f"array({', '.join(f'{x!r}D' for x in xs)})"
    first = f"array({', '.join(listed(r) for r in rates)})"
    start = f"named_struct('share', {listed(shares)}, 'against', {first})"
    total = "aggregate(sequence(0, size(p) - 1), 0D, (a, k) -> a + {})".format
    share = f"least({MOST}D, greatest({LEAST}D, ({total('p[k].n * q[k][c]')} + 0.5D) / ({total('p[k].n')} + 1D)))"
    against = f"""({total('if(p[k].votes[j] = -1, p[k].n * q[k][c], 0D)')} + 2D * begun[c][j])
      / ({total('if(p[k].votes[j] = 0, 0D, p[k].n * q[k][c])')} + 2D)"""
    step = f"""(s, r) -> get(transform(array(transform(p, x -> {_posterior("x.votes", "s")})), q -> named_struct(
      'share', transform(sequence(0, {classes - 1}), c -> {share}),
      'against', transform(sequence(0, {classes - 1}), c -> transform(sequence(0, {m - 1}), j ->
        least(if(c = 0, {MOST_ON_GOOD}D, {MOST}D), greatest({LEAST}D, {against})))))), 0)"""
    em = f"get(transform(array({first}), begun -> aggregate(sequence(1, {rounds}), {start}, {step})), 0)"
    return gathered.select(F.expr(f"case when size(p) = 0 then {start} else {em} end").alias("model"))


def _posterior(votes_of: str, model: str) -> str:
    """Probabilities of the classes from a text's votes, taken to be independent given the class."""
    weight = (f"case {votes_of}[v] when -1 then ln({model}.against[d][v]) when 1 then ln(1 - {model}.against[d][v]) else 0D end")
    logs = f"transform({model}.share, (h, d) -> aggregate(sequence(0, {len(RULES) - 1}), ln(h), (o, v) -> o + {weight}))"
    return f"get(transform(array({logs}), l -> transform(l, e -> 1 / aggregate(l, 0D, (z, f) -> z + exp(f - e)))), 0)"


def judged(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Measures of every text with ``votes``, ``posterior``, ``base_failed`` and ``kept``.

    The base rules fail a text of fewer than 10 words, or more than a fifth of whose words
    are in repeated windows; such a text is never kept, others are if ``posterior`` is at
    least one half. Null texts are empty and fail; null ids stay; repeated rows count and
    appear as often as they occur; other columns are ignored; an empty table gives no rows.
    """
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    voted = votes(measures(df, id_col, text_col)).withColumn("base_failed", failed)
    voted = materialise(voted, "quality-votes")
    scored = voted.withColumn("model", accuracies(voted.filter("not base_failed")).scalar())
    scored = scored.withColumn("posterior", F.expr(f"get({_posterior('votes', 'model')}, 0)")).drop("model")
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))
