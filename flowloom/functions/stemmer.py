"""English stemming (the published Porter2 rules), as one set of rules with two readers: a Column form for rows, a Python form for query words.

Words are lower-case ASCII letters and digits. R1 is what follows the first consonant after a vowel, R2 the same within R1; a suffix is replaced only
where it lies in its region. The longest suffix of a step decides, whether its condition holds or not.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The rules' word lists and suffixes.
EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
LEFT_AFTER_1A = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
REGION_PREFIXES = "gener|commun|arsen"
STEP_2 = [
    ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("entli", "ent"), ("izer", "ize"), ("ization", "ize"), ("ational", "ate"), ("ation", "ate"), ("ator", "ate"),
    ("alism", "al"), ("aliti", "al"), ("alli", "al"), ("fulness", "ful"), ("ousli", "ous"), ("ousness", "ous"), ("iveness", "ive"), ("iviti", "ive"), ("biliti", "ble"), ("bli", "ble"),
    ("ogi", "og", "l$"), ("fulli", "ful"), ("lessli", "less"), ("li", "", "[cdeghkmnrt]$"),
]
STEP_3 = [("tional", "tion"), ("ational", "ate"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""), ("ative", "", None, 2)]
STEP_4 = [(s, "", None, 2) for s in ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize")] + [("ion", "", "[st]$", 2)]

VOWEL = "[aeiouy]"
REGION = f"^(?:{REGION_PREFIXES}|.*?{VOWEL}[^aeiouy])"
#: A short syllable at the end.
SHORT = "(?:^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$"
DOUBLE = r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$"


class Words:
    """The operations that rules are written in, on Python strings."""

    has = staticmethod(lambda w, pattern: re.search(pattern, w) is not None)
    cut = staticmethod(lambda w, n, add="": (w[:-n] if n else w) + add)
    size = staticmethod(len)
    ends = staticmethod(str.endswith)
    pick = staticmethod(lambda cases, other: next((v for c, v in cases if c), other))
    both = staticmethod(lambda *c: all(c))
    let = staticmethod(lambda value, use: use(value))
    sub = staticmethod(lambda w, pattern, new: re.sub(pattern, new, w))

    @staticmethod
    def start(w, pattern, after=0):
        found = re.search(pattern, w[after:])
        return after + len(found.group()) if found else len(w)


class Columns:
    """The same on Columns; `let` binds a value once, so that steps don't repeat what comes before them."""

    has = staticmethod(lambda w, pattern: w.rlike(pattern))
    cut = staticmethod(lambda w, n, add="": F.concat(F.substr(w, F.lit(1), F.length(w) - n), F.lit(add)))
    size = staticmethod(F.length)
    ends = staticmethod(lambda w, suffix: w.endswith(suffix))
    let = staticmethod(lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0)))
    sub = staticmethod(lambda w, pattern, new: F.regexp_replace(w, pattern, new))

    @staticmethod
    def pick(cases, other):
        out = None
        for c, v in cases:
            out = F.when(c, v) if out is None else out.when(c, v)
        return out.otherwise(other)

    @staticmethod
    def both(*conditions):
        out = conditions[0]
        for c in conditions[1:]:
            out = out & c
        return out

    @staticmethod
    def start(w, pattern, after=0):
        rest = F.substr(w, F.lit(1) + after, F.length(w))
        found = F.length(F.regexp_extract(rest, pattern, 0))
        return F.when(found > 0, found + after).otherwise(F.length(w))


def replaced(on, w, rules, regions):
    """The rule of the longest suffix that w ends with: (suffix, new, pattern the stem must match, region)."""
    cases = []
    for suffix, new, *more in sorted(rules, key=lambda r: -len(r[0])):
        before, region = (*more, None, None)[:2]
        fits = [on.size(w) >= regions[(region or 1) - 1] + len(suffix)]
        if before:
            fits.append(on.has(on.cut(w, len(suffix)), before))
        cases.append((on.ends(w, suffix), on.pick([(on.both(*fits), on.cut(w, len(suffix), new))], w)))
    return on.pick(cases, w)


def step_1a(on, w):
    return on.pick([
        (on.ends(w, "sses"), on.cut(w, 2)),
        (on.has(w, "ie[ds]$"), on.pick([(on.size(w) > 4, on.cut(w, 2))], on.cut(w, 1))),
        (on.has(w, "[us]s$"), w),
        (on.has(w, f"{VOWEL}.+s$"), on.cut(w, 1)),
    ], w)


def step_1b(on, w, r1):
    def mended(v):
        return on.pick([(on.has(v, "(at|bl|iz)$"), on.cut(v, 0, "e")), (on.has(v, DOUBLE), on.cut(v, 1)), (on.both(on.has(v, SHORT), on.size(v) <= r1), on.cut(v, 0, "e"))], v)

    cases = [(on.ends(w, s), on.pick([(on.size(w) >= r1 + len(s), on.cut(w, len(s), "ee"))], w)) for s in ("eedly", "eed")]
    for s in ("ingly", "edly", "ing", "ed"):
        cases.append((on.ends(w, s), on.pick([(on.has(on.cut(w, len(s)), VOWEL), on.let(on.cut(w, len(s)), mended))], w)))
    return on.pick(cases, w)


def step_5(on, w, r1, r2):
    long = on.pick([(on.size(w) >= r2 + 1, on.cut(w, 1)), (on.both(on.size(w) >= r1 + 1, on.has(w, "e$")), on.pick([(on.has(on.cut(w, 1), SHORT), w)], on.cut(w, 1)))], w)
    return on.pick([(on.ends(w, "e"), long), (on.has(w, "ll$"), on.pick([(on.size(w) >= r2 + 1, on.cut(w, 1))], w))], w)


def rules(on, word):
    def from_regions(w, r1, r2):
        def after_1a(w):
            steps = [
                lambda w: step_1b(on, w, r1), lambda w: on.pick([(on.has(w, ".[^aeiouy][yY]$"), on.cut(w, 1, "i"))], w), lambda w: replaced(on, w, STEP_2, (r1, r2)),
                lambda w: replaced(on, w, STEP_3, (r1, r2)), lambda w: replaced(on, w, STEP_4, (r1, r2)), lambda w: step_5(on, w, r1, r2),
            ]

            def go(w, left):
                return on.let(left[0](w), lambda v: go(v, left[1:])) if left else on.sub(w, "Y", "y")

            return on.pick([(on.has(w, f"^({'|'.join(LEFT_AFTER_1A)})$"), w)], go(w, steps))

        return on.let(step_1a(on, w), after_1a)

    def marked(w):
        return on.let(on.start(w, REGION), lambda r1: on.let(on.start(w, f"^.*?{VOWEL}[^aeiouy]", r1), lambda r2: from_regions(w, r1, r2)))

    marked_y = on.sub(on.sub(word, "^y", "Y"), "(?<=[aeiouy])y", "Y")
    special = [(on.has(word, f"^{k}$"), v if on is Words else F.lit(v)) for k, v in EXCEPTIONS.items()]
    return on.pick([(on.size(word) <= 2, word), *special], on.let(marked_y, marked))


def stem(word: str) -> str:
    return rules(Words, word.lower())


def stem_column(word: Column) -> Column:
    """The stem of a column of lower-case words."""
    return rules(Columns, word)
