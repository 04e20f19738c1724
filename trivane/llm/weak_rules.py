"""Quality rules as weak supervision, in DataFrame operations only.

Every rule votes good (1), bad (-1) or abstains (0). Expectation-maximisation
over the counts of vote patterns estimates how often each rule is right, and a
document is kept by its posterior probability of being good. The pattern table
has at most 3^rules rows whatever the size of the corpus.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trivane.llm.common import let, materialise

#: White space that separates words.
SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
#: The beginning of a word up to its first symbol.
_MARKED = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D#*$%&|<>]*+[#*$%&|<>]"
#: Bits that hold a word's position beside the truncated window hash.
POSITION_BITS = 24

FEATURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_bang", "n_letters", "n_marked"]


@dataclass(frozen=True)
class Rule:
    """good and bad are SQL conditions over FEATURES; neither holding, or both, is an abstention."""

    name: str
    good: str
    bad: str


RULES = (
    Rule("length", "n_words >= 100", "n_words < 60"),
    Rule("symbols", "50 * n_symbols <= n_words", "10 * n_symbols > n_words"),
    Rule("marked", "50 * n_marked <= n_words", "10 * n_marked > n_words"),
    Rule("letters", "100 * n_letters >= 92 * word_chars", "100 * n_letters < 85 * word_chars"),
    Rule("repeats", "10 * n_repeat_words <= 2 * n_words", "10 * n_repeat_words > 4 * n_words"),
    Rule("dup_lines", "n_lines >= 2 and 10 * n_dup_lines <= n_lines", "n_dup_lines >= 3 and 10 * n_dup_lines > 3 * n_lines"),
    Rule("word_length", "word_chars >= 3 * n_words and word_chars <= 8 * n_words", "word_chars < 2 * n_words or word_chars > 12 * n_words"),
    Rule("capitals", "10 * n_upper <= 2 * word_chars", "10 * n_upper > 4 * word_chars"),
    Rule("exclaim", "50 * n_bang <= n_words", "5 * n_bang > n_words"),
)
#: Prior chance of good; share of the documents added as pseudo-counts; rounds of the estimation.
PRIOR, WEIGHT, ROUNDS = 0.8, 0.02, 12
#: Chance that a vote is bad in good (1) and bad (0) documents at the start and among the pseudo-counts: only this tells the classes apart.
START = {1: 0.05, 0: 0.3}


def _repeat_words(words: Column) -> Column:
    """Words inside a 3-word window that the text holds twice or more.

    Windows are hashed; a text whose windows all differ is done. Otherwise (truncated hash, position) packed in one long is
    sorted to find the few windows that may repeat; those alone are then compared
    by the whole hash. Texts of more than 2^24 words skip the packing.
    """
    mask = (1 << POSITION_BITS) - 1

    def covered(pairs: Column) -> Column:
        def same(s: Column) -> Column:
            def near(x, i):
                left = F.when(i > 0, F.get(s, i - 1)["h"] == x["h"])
                return F.coalesce(left, F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))

            hit = F.filter(s, near)
            return F.size(F.array_distinct(F.flatten(F.transform(hit, lambda x: F.array(x["p"], x["p"] + 1, x["p"] + 2)))))

        return let(F.sort_array(pairs), same)

    def from_windows(w: Column) -> Column:
        def packed(s: Column) -> Column:
            high = lambda x: F.shiftright(x, POSITION_BITS)

            def near(x, i):
                left = F.when(i > 0, high(F.get(s, i - 1)) == high(x))
                return F.coalesce(left, F.lit(False)) | F.coalesce(high(F.get(s, i + 1)) == high(x), F.lit(False))

            at = lambda x: x.bitwiseAND(F.lit(mask)).cast("int")
            return covered(F.transform(F.filter(s, near), lambda x: F.struct(F.get(w, at(x)).alias("h"), at(x).alias("p"))))

        none = F.size(F.array_distinct(w)) == F.size(w)
        short = let(F.sort_array(F.transform(w, lambda x, i: F.shiftleft(x, POSITION_BITS).bitwiseOR(i.cast("long")))), packed)
        long = covered(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        return F.when(none, F.lit(0)).when(F.size(w) <= mask, short).otherwise(long)

    def from_hashes(h: Column) -> Column:
        steps = F.sequence(F.lit(0), F.size(h) - 3)
        return let(F.transform(steps, lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2))), from_windows)

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(F.transform(words, lambda x: F.xxhash64(x)), from_hashes)).cast("long")


def document_features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add FEATURES (long) and base_failed. A null text counts as an empty one."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = docs.withColumn("__text", text).withColumn(
        "__words", F.filter(F.split("__text", SPACE + "+"), lambda x: x != "")
    ).withColumn("__lines", F.filter(F.split("__text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    n = lambda chars: F.length("__text") - F.length(F.translate("__text", chars, ""))
    named = {
        "n_words": F.size("__words"),
        "word_chars": F.length(F.translate("__text", " \t\n\x0b\x0c\r", "")),
        "n_symbols": n(SYMBOLS),
        "n_lines": F.size("__lines"),
        "n_dup_lines": F.size("__lines") - F.size(F.array_distinct("__lines")),
        "n_repeat_words": _repeat_words(F.col("__words")),
        "n_upper": F.length("__text") - F.length(F.regexp_replace("__text", r"\p{Lu}", "")),
        "n_bang": n("!"),
        "n_letters": F.length(F.regexp_replace("__text", r"\P{L}+", "")),
        "n_marked": F.regexp_count("__text", F.lit(_MARKED)),
    }
    out = split.withColumns({k: v.cast("long") for k, v in named.items()}).drop("__text", "__words", "__lines")
    return out.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))


def votes(rules=RULES) -> dict[str, Column]:
    return {
        f"v_{r.name}": F.expr(f"case when ({r.good}) and not ({r.bad}) then 1 when ({r.bad}) and not ({r.good}) then -1 else 0 end")
        for r in rules
    }


def _posterior(params: dict, names: list[str]) -> Column:
    """Probability of good given the votes; params[name][y] is the chance that a vote in class y is bad. Abstentions say nothing."""
    good, bad = F.lit(math.log(params["prior"])), F.lit(math.log(1 - params["prior"]))
    for k in names:
        chance = lambda y, k=k: F.when(F.col(k) == 1, math.log(1 - params[k][y])).when(F.col(k) == -1, math.log(params[k][y])).otherwise(0.0)
        good, bad = good + chance(1), bad + chance(0)
    return 1 / (1 + F.exp(bad - good))


def estimate(patterns: DataFrame, names: list[str], rounds: int = ROUNDS) -> dict:
    """Expectation-maximisation over patterns(names..., n); no patterns give the starting values.

    Each rule's accuracy is estimated apart for good and for bad documents. WEIGHT
    of the documents are added as pseudo-counts that vote as START says, which
    keeps the classes from changing places. The patterns, 3^rules rows at most, are
    read once and go into the plan of every round as values.
    """
    rows = patterns.select(*names, "n").collect()
    if not rows:
        return {"prior": PRIOR} | {k: START for k in names}
    values = ", ".join("(" + ", ".join(f"{x}L" if c == "n" else str(x) for c, x in r.asDict().items()) + ")" for r in rows)
    patterns = patterns.sparkSession.sql(f"select * from values {values} as t({', '.join([*names, 'n'])})")
    params = {"prior": PRIOR} | {k: START for k in names}
    for _ in range(rounds):
        p = patterns.withColumn("g", _posterior(params, names))
        sums = [F.sum("n").alias("n"), F.sum(F.col("n") * F.col("g")).alias("good")]
        for k in names:
            for y, g in ((1, F.col("g")), (0, 1 - F.col("g"))):
                sums += [F.sum(F.when(F.col(k) == -1, F.col("n")).otherwise(0) * g).alias(f"bad{y}_{k}"), F.sum(F.when(F.col(k) != 0, F.col("n")).otherwise(0) * g).alias(f"all{y}_{k}")]
        row = p.agg(*sums).first()
        extra = WEIGHT * row["n"]
        params = {"prior": (row["good"] + extra * PRIOR) / (row["n"] + extra)} | {
            k: {y: (row[f"bad{y}_{k}"] + extra * START[y]) / (row[f"all{y}_{k}"] + extra) for y in (1, 0)} for k in names
        }
    return params


def quality_rules(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None, rules=RULES, keep_at: float = 0.5) -> DataFrame:
    """Score documents by the posterior of the rules' votes.

    Returns the columns in ``carry`` (default: all of ``docs``), FEATURES, base_failed, posterior double and
    kept boolean (false if base_failed, else posterior >= keep_at). Features are
    written once to the shared folder, so the texts are read once. Null and
    empty texts have no words and so fail the base rules; repeated rows count
    each time; an empty table gives no rows. Columns of ``docs`` that clash with added
    names are replaced unless they are carried under another name. Very long texts count whole; documents with
    equal votes have equal posteriors, and a posterior of keep_at itself is enough.
    """
    keep = list(docs.columns) if carry is None else carry
    keep = [c for c in keep if c not in {*FEATURES, "base_failed", "posterior", "kept"}]
    read = docs.select(*dict.fromkeys([*keep, text_col]))
    table = materialise(document_features(read, text_col).select(*keep, *FEATURES, "base_failed"), "rules")
    v = votes(rules)
    patterns = materialise(table.select(*[c.alias(k) for k, c in v.items()]).groupBy(*v).agg(F.count("*").alias("n")).coalesce(1), "votes")
    params = estimate(patterns, list(v))
    scored = table.withColumns(v).withColumn("posterior", _posterior(params, list(v)))
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= keep_at)).drop(*v)
