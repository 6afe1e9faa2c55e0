"""Personal data by fixed forms and by bootstrapped contexts, in DataFrame functions only.

The fixed forms (email, ip, card, phone, and keys written as digits of base 16) give the seeds. The words around seeds
induce lexical patterns. Patterns and the values they surround make a graph; Spark scores it in rounds: a pattern is as
good as the share of its values that are believed, a value as good as its patterns together. Patterns that end up sure
mark values that no fixed form finds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored, text_or_empty

#: In the order in which spans are listed. The first BASE of them have forms that count as found whatever stands around.
KINDS = ("email", "ip", "card", "phone", "secret")
BASE = 4
#: The number that candidates bear in the place of a kind.
CANDIDATE = -1

_LOCAL, _HOST, _BLANK = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]", r"\x20\x09-\x0D"
#: The forms, with guards and possessive runs so that the search stays linear in long runs of one kind of character. A
#: guard only skips starts that the plain form would have passed, or tried in vain: inside a run that it takes whole.
FORMS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?=[0-9])(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?=[0-9])(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: The seeds of secrets: 40 lower-case digits of base 16 (as of a hash or a key), with letters and decimals.
SECRET = r"(?<![0-9A-Za-z])(?=[a-f]*+[0-9])(?=[0-9]*+[a-f])[0-9a-f]{40}(?![0-9A-Za-z])"
#: What a pattern may mark, from the start of a token on: an address spelled out; groups of digits; a token with an at sign,
#: six digits, or two colons among digits of base 16.
_START, _TOKEN = rf"(?<![^{_BLANK}])", rf"[^{_BLANK}]++"
_SPELLED = rf"{_TOKEN}\x20(?:at|\(at\)|\[at\])\x20{_TOKEN}(?:\x20(?:dot|\(dot\)|\[dot\])\x20{_TOKEN})++"
_GROUPS = r"[0-9(+][0-9().+-]*+(?:\x20[0-9(][0-9().+-]*+)++"
_ONE = rf"(?=[^{_BLANK}@]*+@|(?:[^{_BLANK}0-9]*+[0-9]){{6}}|[0-9A-Fa-f]*+:[0-9A-Fa-f]*+:){_TOKEN}"
CANDIDATES = rf"{_START}(?:{_SPELLED}|{_GROUPS}|{_ONE})"
#: Code points on either side of a match that are searched for its context.
REACH = 80


def _luhn(match: Column) -> Column:
    digits = F.reverse(F.regexp_replace(match, "[^0-9]", ""))
    values = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.when(i % 2 == 1, F.substring(digits, i, F.lit(1)).cast("int")).otherwise(F.substring(digits, i, F.lit(1)).cast("int") * 2))
    return F.aggregate(values, F.lit(0), lambda s, v: s + F.when(v > 9, v - 9).otherwise(v)) % 10 == 0


def _n_digits(match: Column) -> Column:
    return F.length(F.regexp_replace(match, "[^0-9]", ""))


CHECKS = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: F.forall(F.split(m, r"\.", -1), lambda p: F.coalesce(F.regexp_replace(p, "^0+(?=[0-9])", "").try_cast("int") <= 255, F.lit(False))),
    "card": _luhn,
    "phone": lambda m: _n_digits(m).between(8, 15),
}
#: Whether a document can hold a form at all.
HINTS = {"email": lambda t: F.contains(t, F.lit("@")), "ip": lambda t: t.rlike("[0-9]"), "card": lambda t: t.rlike("[0-9]"), "phone": lambda t: F.contains(t, F.lit("+"))}

def _matches(text: Column, form: str, hint: Column, kind: int) -> Column:
    """The leftmost non-overlapping matches, each with its number, the length of the gap before it, its own, its value, and
    what stands before and behind it. Matches and gaps are each read once, so the work is linear in the text."""
    found, gaps = F.regexp_extract_all(text, F.lit(form), F.lit(0)), F.split(text, form, -1)
    # What an element needs of its neighbours is laid beside it: an array named inside the lambda would be made anew each time.
    last, rest = F.array(F.lit("")), lambda of: F.slice(of, 2, F.greatest(F.lit(1), F.size(of)))
    beside = F.arrays_zip(gaps.alias("gap"), found.alias("value"), F.concat(last, found).alias("last"), rest(gaps).alias("next_gap"), rest(found).alias("next"))

    def one(x: Column, i: Column) -> Column:
        text_of = lambda c: F.coalesce(x[c], F.lit(""))
        before, behind = F.concat(text_of("last"), text_of("gap")), F.concat(text_of("next_gap"), text_of("next"))
        sides = F.right(before, F.lit(REACH)).alias("before"), F.left(behind, F.lit(REACH)).alias("behind")
        return F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(text_of("gap")).alias("gap"), F.length(x["value"]).alias("size"), x["value"].alias("value"), *sides)

    # Behind the last match one gap is left over.
    pairs = F.filter(beside, lambda x: x["value"].isNotNull())
    return F.when(hint & text.rlike(form), F.transform(pairs, one)).otherwise(F.array().cast(_MATCHES))


_MATCHES = "array<struct<kind:int,i:int,gap:int,size:int,value:string,before:string,behind:string>>"


def mentions(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(rid, doc_id, found): a row for each document with the matches of every form and the candidates; no text."""
    t = F.col("text")
    digit = t.rlike("[0-9]")
    every = [_matches(t, FORMS[k], HINTS[k](t), i) for i, k in enumerate(KINDS[:BASE])]
    every += [_matches(t, SECRET, digit, BASE), _matches(t, CANDIDATES, F.contains(t, F.lit("@")) | digit | F.contains(t, F.lit(" at")) | F.contains(t, F.lit(" (at")) | F.contains(t, F.lit(" [at")), CANDIDATE)]
    body = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"))
    return body.select("rid", "doc_id", F.concat(*every).alias("found"))


def placed(each: DataFrame) -> DataFrame:
    """(rid, kind, start, end, value, before, behind) of the matches that pass their checks and of the candidates outside of
    them. Places are running sums over the matches of one form, candidates lose the signs at their ends."""
    rows = each.select("rid", F.explode("found").alias("m")).select("rid", "m.*")
    so_far = W.partitionBy("rid", "kind").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    ends = rows.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(so_far).cast("int")).withColumn("start", F.col("end") - F.col("size"))
    value, is_candidate = F.col("value"), F.col("kind") == CANDIDATE
    signs = r"^[^\p{L}\p{N}+]*+"
    head, tail = F.regexp_extract(value, signs, 0), F.reverse(F.regexp_extract(F.reverse(value), signs.replace("+]", "]"), 0))
    core = F.substring(value, F.length("head") + 1, F.greatest(F.lit(0), F.length(value) - F.length("head") - F.length("tail")))
    cut = ends.withColumns({"head": F.when(is_candidate, head).otherwise(""), "tail": F.when(is_candidate, tail).otherwise("")}).where(F.length("head") < F.length(value))
    trimmed = cut.select("rid", "kind", (F.col("start") + F.length("head")).alias("start"), (F.col("end") - F.length("tail")).alias("end"), core.alias("value"), F.concat("before", "head").alias("before"), F.concat("tail", "behind").alias("behind"))
    passes = F.coalesce(*[F.when(F.col("kind") == i, CHECKS[k](F.col("value"))) for i, k in enumerate(KINDS[:BASE])], F.lit(True))
    good = trimmed.where(passes)
    # Base forms stay in any case; secrets give way to them, candidates to both.
    rank = F.when(F.col("kind") == CANDIDATE, 2).when(F.col("kind") >= BASE, 1).otherwise(0)
    return _clear(_clear(good.withColumn("rank", rank), 1), 2).drop("rank")


def _clear(rows: DataFrame, rank: int) -> DataFrame:
    """rows without those of a rank that overlap one of a lower rank; one sweep from either end of a document."""
    firm = F.col("rank") < rank
    up = W.partitionBy("rid").orderBy("start", "rank").rowsBetween(W.unboundedPreceding, 0)
    down = W.partitionBy("rid").orderBy(F.desc("start"), F.desc("rank")).rowsBetween(W.unboundedPreceding, 0)
    reach, following = F.max(F.when(firm, F.col("end"))).over(up), F.min(F.when(firm, F.col("start"))).over(down)
    met = rows.withColumns({"_reach": reach, "_next": following})
    overlaps = F.coalesce(F.col("_reach") > F.col("start"), F.lit(False)) | F.coalesce(F.col("_next") < F.col("end"), F.lit(False))
    return met.where((F.col("rank") != rank) | ~overlaps).drop("_reach", "_next")


def with_patterns(rows: DataFrame) -> DataFrame:
    """A row for each span and pattern: the three words before it, or the word on either side; all in lower case."""
    blanks = rf"[{_BLANK}]+"
    left = F.split(F.lower(F.regexp_replace(F.col("before"), rf"[{_BLANK}]++$", "")), blanks, -1)
    right = F.split(F.lower(F.regexp_replace(F.col("behind"), rf"^[{_BLANK}]++", "")), blanks, -1)
    word = lambda words, i: F.coalesce(F.try_element_at(words, F.lit(i)), F.lit(""))
    patterns = F.array(F.concat_ws("\t", F.lit("left"), *(word(left, i) for i in (-3, -2, -1))), F.concat_ws("\t", F.lit("near"), *(word(left, i) for i in (-2, -1))), F.concat_ws("\t", F.lit("both"), word(left, -1), word(right, 1)))
    return rows.select("rid", "kind", "start", "end", F.lower("value").alias("value"), F.explode(patterns).alias("pattern"))


def scored_patterns(found: DataFrame, rounds: int = 3, min_values: int = 3) -> DataFrame:
    """(pattern, kind, sure): how sure each pattern is of a kind after so many rounds over the pattern-value graph.

    A value counts once a pattern, however many copies of a document repeat it. A pattern needs min_values believed
    values. Values of a fixed form are believed fully throughout.
    """
    edges = found.groupBy("pattern", "value").agg(F.max("kind").alias("kind"))
    seeds = edges.where(F.col("kind") >= 0).select("value", "kind", F.lit(1.0).alias("belief")).distinct()
    links = edges.select("pattern", "value")
    totals = links.groupBy("pattern").agg(F.count("*").alias("n"))
    beliefs, patterns = seeds, None
    for i in range(rounds):
        hits = links.join(beliefs, "value").groupBy("pattern", "kind").agg(F.sum("belief").alias("hits"))
        patterns = hits.where(F.col("hits") >= min_values).join(totals, "pattern").select("pattern", "kind", (F.col("hits") / F.col("n")).alias("sure"))
        if i + 1 == rounds:
            break
        # One less the product of the doubts; seeds stay as they are. Each round is written down, which cuts the plan.
        doubt = F.sum(F.log(F.greatest(F.lit(1e-6), 1 - F.col("sure"))))
        guessed = links.join(patterns, "pattern").groupBy("value", "kind").agg((1 - F.exp(doubt)).alias("belief"))
        beliefs = stored(seeds.unionByName(guessed.join(seeds.select("value").distinct(), "value", "left_anti")), "pii-beliefs")
    return patterns


def plausible(kind: Column, value: Column) -> Column:
    """Whether an unseen value (in lower case) may be of a kind."""
    n, letters = _n_digits(value), value.rlike("[a-z]")
    looks = {
        0: F.contains(value, F.lit("@")) | value.rlike(r"\x20[(\[]?at[)\]]?\x20"), 1: value.rlike(r"^[0-9a-f]*+(?:[.:][0-9a-f]*+){2,}+$"),
        2: n.between(12, 19) & ~letters, 3: n.between(7, 15) & ~letters, 4: value.rlike(r"^[a-z0-9_./+=-]{12,}+$") & (n >= 4),
    }
    return F.coalesce(*[F.when(kind == k, c) for k, c in looks.items()], F.lit(False))


def discovered(found: DataFrame, sure: float = 0.8, rounds: int = 3, min_values: int = 3) -> DataFrame:
    """(rid, kind, start, end) of the candidates that a sure pattern marks, of the surest kind; found: see with_patterns."""
    patterns = scored_patterns(found, rounds, min_values).where(F.col("sure") >= sure).select("pattern", F.col("kind").alias("as_kind"), "sure")
    hits = found.where(F.col("kind") == CANDIDATE).join(patterns, "pattern").where(plausible(F.col("as_kind"), F.col("value")))
    return hits.groupBy("rid", "start", "end").agg(F.max(F.struct("sure", (-F.col("as_kind")).alias("k"))).alias("b")).select("rid", (-F.col("b.k")).alias("kind"), "start", "end")


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sure: float = 0.8, rounds: int = 3, min_values: int = 3) -> DataFrame:
    """(doc_id, base, spans): sorted arrays of (kind, start, end), kind as a place in KINDS, code points, end exclusive.

    base holds the matches of the four fixed forms; spans holds those, the seeds of secrets, and the candidates that
    patterns at least ``sure`` mark. Null and empty texts have none. Texts may have any length and are searched whole, in
    time linear in it. Repeated rows, and rows that share an id, each get their own spans. Null ids stay null. An empty
    table gives an empty one. Other columns are left out, whatever their names.
    """
    # The forms are searched once; what follows reads matches and their surroundings, and no text.
    each = stored(mentions(docs, doc_id, text), "pii-mentions")
    rows = stored(placed(each), "pii-placed")
    more = discovered(with_patterns(rows), sure, rounds, min_values)
    known = rows.where(F.col("kind") >= 0).select("rid", "kind", "start", "end").unionByName(more)
    spans = known.groupBy("rid").agg(F.array_sort(F.collect_set(F.struct("kind", "start", "end"))).alias("spans"))
    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    both = each.select("rid", "doc_id").join(spans, "rid", "left").select("rid", "doc_id", F.coalesce("spans", none).alias("spans"))
    base = rows.where(F.col("kind").between(0, BASE - 1)).groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end"))).alias("base"))
    return both.join(base, "rid", "left").select("doc_id", F.coalesce("base", none).alias("base"), "spans")


def listed(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
