"""Personal information in free text by bootstrapped contextual extraction.

1. Candidates: spans that look like an e-mail address, a number, a postal address or a name, with the words
   around them (:mod:`glyphgrove.llm.personal_shapes`). Few of them are seeds, for a kind or against all: those right
   after one of a few words for each kind, streets of five kinds and plain mail addresses with two endings.
2. A bipartite graph of instances and patterns (words to the left, words to the right, form, given name, family
   name). Each round a pattern's confidence for a kind is the share of its labelled instances that have that
   kind, with unlabelled ones counting against it; then instances that meet confident patterns get their kind and
   keep it; what speaks against all kinds is judged anew. Patterns of context and of form take turns: a seed's context has instances of other forms, these stand in
   other contexts, and so on.
3. When a round labels nothing new, instances with a kind are joined back to their documents. Every kind is decided by
   the graph alone; a form or a label by itself puts nothing into the result, but for the seeds.

Instances are distinct (pool, text, surroundings): copies of a text count once, however many there are, and are
merged by a combinable aggregate before any shuffle by pattern. Patterns are aggregated map-side; a pattern as
common as a third of all instances is one row after aggregation and a hot key of the join back, whose two sides are
each shuffled for it, so adaptive execution splits it.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphgrove.llm import personal_shapes
from glyphgrove.runtime import apart, durable, spread

KINDS = ("email", "phone", "id_number", "address", "person")

#: Least confidence of a pattern that labels an instance, and of a form that does so for numbers; distinct labelled
#: instances that a pattern needs, in general and for names, whose words are common.
CONFIDENT, SURE_FORM, SUPPORT, NAME_SUPPORT = 0.6, 0.65, 2, 4
#: Weight of unlabelled instances in a pattern's confidence, and labelled ones against it that every pattern is given, by
#: pool: unlabelled names are mostly none.
UNKNOWN_WEIGHT = {"mail": 0.02, "address": 0.02, "number": 0.05, "name": 0.25}
DOUBT = {"mail": 0.5, "address": 0.5, "number": 0.5, "name": 1.0}
#: What a pattern of two words counts beside one of three, which knows more of the place.
SHORT_PATTERN = 0.8
#: Share of lower-case among a word's uses from which a name with it is taken for none, as long as nothing speaks for it.
COMMON = 0.3

_SCHEMA = "{id} {kind}, pool string, found string, seed string, left array<string>, right array<string>, form string, given string, family string, at int"


def extract(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per candidate and document. Null and empty texts have none; texts are read whole.

    Rows of the pool ``word`` have a null id: they count the uses of words (``found``, number in ``at``) per batch, those
    in lower case with the form ``lower``.
    """

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, *c) for i, t in zip(batch[ident], batch[text], strict=True) for c in personal_shapes.candidates(t)]
            words = Counter(w for t in batch[text] for w in personal_shapes.word_uses(t))
            rows += [(None, "word", w, None, [], [], form, "", "", n) for (w, form), n in words.items()]
            yield pd.DataFrame(rows, columns=[ident, "pool", "found", "seed", "left", "right", "form", "given", "family", "at"])

    kind = docs.schema[ident].dataType.simpleString()
    return spread(docs.select(ident, text).filter(F.length(text) > 0), ident).mapInPandas(find, _SCHEMA.format(id=ident, kind=kind))


def _patterns() -> Column:
    """(role, value) of an instance's patterns; roles of context begin with ``c``."""
    left, right, pool = F.col("left"), F.col("right"), F.col("pool")
    wide = lambda side, n: F.concat_ws(" ", F.slice(side, 1, n))
    p = lambda role, value: F.struct(F.lit(role).alias("role"), F.concat_ws("|", pool, value).alias("value"))
    parts = [p("given", F.col("given")), p("family", F.col("family")), p("ending", F.right("family", F.lit(4)))]
    name = F.when(pool == "name", F.array(*parts)).otherwise(F.array(p("form", F.col("form"))))
    context = F.array(
        p("c_left3", wide(left, 3)),
        p("c_left2", wide(left, 2)),
        p("c_right3", wide(right, 3)),
        p("c_right2", wide(right, 2)),
        p("c_both", F.concat_ws(" _ ", wide(left, 1), wide(right, 1))),
    )
    told = lambda x: F.substring_index(x["value"], "|", -1).rlike(r"\pL")
    return F.concat(F.filter(name, lambda x: ~x["value"].endswith("|")), F.filter(context, told))


def bootstrap(candidates: DataFrame) -> DataFrame:
    """``instance, label`` of every candidate instance; null where nothing speaks for a kind or against all.

    ``more_given`` and ``more_family`` tell that a pair of names begins with a given name, or ends with a family name,
    by which it may lengthen a name that it overlaps.

    ``candidates`` needs the columns of :func:`candidates_of`, of which ``instance`` settles all but the seed; where
    occurrences of an instance have different seeds, the first in alphabetical order holds, whatever order rows come in.
    Rounds end when one gives no instance a kind; as kinds are kept, that comes about at last.
    A name with a common word counts as none as long as nothing speaks for it; that says what its surroundings are
    worth, but nothing of its words, which also stand in names.
    """
    content = candidates.groupBy("instance").agg(F.min("seed").alias("seed"), *[F.first(c).alias(c) for c in ("pool", "left", "right", "form", "given", "family", "given_lower", "family_lower")])
    prior = F.when((F.col("pool") == "name") & (F.greatest("given_lower", "family_lower") >= COMMON), "none")
    columns = ["instance", "pool", "seed", "prior", "given_lower", "family_lower", "look", "given_name", "patterns"]
    # an instance takes its patterns along, so that its label is at hand wherever they are counted
    state = content.withColumns({"prior": prior, "look": F.col("form"), "given_name": F.col("given"), "patterns": _patterns()}).select(*columns)
    state = durable(state.withColumns({"label": F.coalesce("seed", "prior"), "sure": F.col("seed").isNotNull()}))
    classes = (*KINDS, "none")
    pair = (F.col("pool") == "name") & (F.col("look") != "reversed") & (F.coalesce("seed", F.lit("person")) == "person")
    more = {f"more_{n}": pair & (F.coalesce(n, F.lit(0.0)) >= least) & (F.col(f"{n}_lower") < COMMON) for n, least in (("given", 0.6), ("family", 0.3))}
    counts = F.col("sure") | F.col("role").startswith("c_")
    by_pool = lambda values: F.coalesce(*[F.when(F.startswith("value", F.lit(f"{k}|")), F.lit(v)) for k, v in values.items()])
    unlabelled, doubt = by_pool(UNKNOWN_WEIGHT), by_pool(DOUBT)
    grown = True
    while grown:
        count = [F.sum(((F.col("label") == k) & counts).cast("int")).alias(k) for k in classes]
        edges = state.select("instance", "label", "sure", F.explode("patterns").alias("p")).select("instance", "label", "sure", "p.role", "p.value")
        weights = edges.groupBy("role", "value").agg(F.count("*").alias("n"), *[F.coalesce(c, F.lit(0)).alias(k) for c, k in zip(count, classes, strict=True)])
        known = sum((F.col(k) for k in classes), F.lit(0))
        weights = weights.filter(known > 0).select("role", "value", "n", known.alias("known"), *[(F.col(k) / (known + unlabelled * (F.col("n") - known) + doubt)).alias(k) for k in classes])
        met = edges.drop("label", "sure").join(apart(weights, "role", "value"), ["role", "value"])
        context = F.col("role").startswith("c_") & (F.col("known") >= F.when(F.startswith("value", F.lit("name|")), NAME_SUPPORT).otherwise(SUPPORT))
        weight = F.when(F.col("role").isin("c_left2", "c_right2"), SHORT_PATTERN).otherwise(1.0)
        scored = met.groupBy("instance").agg(
            *[F.max(F.when(context, F.col(k) * weight)).alias(f"context_{k}") for k in classes],
            *[F.max(F.when(F.col("role") == "form", F.col(k))).alias(f"form_{k}") for k in classes],
            *[F.max(F.when(F.col("role") == r, F.col("person"))).alias(r) for r in ("given", "family")],
            F.max(F.when((F.col("role") == "ending") & (F.col("known") >= NAME_SUPPORT), F.col("person"))).alias("ending"),
        )
        kept = F.when(F.col("sure") & (F.col("label") != "none"), F.col("label"))
        told = state.join(scored, "instance", "left").withColumn("kept", kept).withColumn("told", F.coalesce("kept", _decide()))
        new = F.col("kept").isNull() & F.coalesce(F.col("told") != "none", F.lit(False))
        told = told.withColumns({**more, "new": new, "label": F.coalesce("told", "prior"), "sure": F.col("told").isNotNull()})
        state = durable(told.select(*columns, "label", "sure", "new", *more))
        grown = not state.filter("new").isEmpty()
    return state.select("instance", "label", *more)


def _decide() -> Column:
    """Kind of an unlabelled instance from the confidence of its patterns, or null.

    A name's surroundings count less the more both of its words are used in lower case, or either where nothing else
    speaks for the name; its given name alone counts less the more the family name is.
    """
    c = lambda name: F.coalesce(name, F.lit(0.0))
    against = c("context_none") >= CONFIDENT
    context = lambda k: (c(f"context_{k}") >= CONFIDENT) & (c(f"context_{k}") > c("context_none"))
    shape = lambda k: (c(f"form_{k}") >= SURE_FORM) & ~F.startswith("look", F.lit("short ")) & ~against
    few = F.length(F.regexp_replace("look", "[^0]", "")) <= 15
    other_form = (c("form_id_number") + c("form_none") >= CONFIDENT) & (c("form_phone") < F.greatest(c("form_id_number"), c("form_none")))
    number = (
        F.when(few & context("id_number") & (c("context_id_number") >= c("context_phone")) & (c("form_phone") < CONFIDENT), "id_number")
        .when(few & ~F.contains("look", F.lit("a")) & (context("phone") | shape("phone")) & ~other_form, "phone")
        .when(few & shape("id_number") & ~context("phone"), "id_number")
        .when(against, "none")
    )
    initial = F.col("given_name").rlike(r"\A(\w\.[ -]?)+\z")
    place = c("context_person") * (1 - F.least("given_lower", "family_lower"))
    told = context("person") & (place >= CONFIDENT)
    family = F.greatest(c("family"), c("ending") * 0.6 * (1 - F.col("family_lower")))
    mixed = F.col("look") != "caps"
    names = (
        F.when((c("given") >= 0.3) & (family >= 0.2), True)
        .when(initial & (family >= 0.3), True)
        .when(mixed & (c("given") * (1 - F.col("family_lower")) >= 0.6) & (F.col("look") == ""), True)
        .when(told & ((c("given") >= 0.2) | (family >= 0.3)), True)
        .when(told & mixed & (c("context_person") * (1 - F.greatest("given_lower", "family_lower")) >= 0.75), True)
    )
    sure = (c("given") >= 0.6) & (c("family") >= 0.3)
    person = F.when(sure, "person").when(against & (c("context_none") >= c("context_person")), "none").when(names, "person")
    address = F.when(((c("form_address") >= CONFIDENT) & ~F.startswith("look", F.lit("open "))) | context("address"), "address")
    mail = F.when((c("form_email") >= CONFIDENT) | context("email"), "email")
    return F.when(F.col("pool") == "mail", mail).when(F.col("pool") == "number", number).when(F.col("pool") == "name", person).when(F.col("pool") == "address", address)


def _instance() -> Column:
    side = lambda c: F.concat_ws(" ", c)
    return F.unhex(F.md5(F.concat_ws("\x1f", "pool", "found", side("left"), side("right"), "form")))


def candidates_of(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """Candidates with their instance and, for names, the shares of lower-case among all uses of either word in the corpus.

    A title makes no seed where both words together are rather lower-case words; ``M.``, which may be an initial, makes
    none before a common word in the family name's place.
    """
    all_rows = durable(extract(docs, ident, text).withColumn("instance", _instance()))
    lower = F.sum(F.when(F.col("form") == "lower", F.col("at")).otherwise(0)) / F.sum("at")
    share = all_rows.filter("pool = 'word'").groupBy(F.col("found").alias("word")).agg(lower.alias("share")).filter("share > 0")
    seen = all_rows.filter("pool <> 'word'")
    parts = F.array(F.struct(F.lit("given_lower").alias("part"), F.col("given").alias("word")), F.struct(F.lit("family_lower").alias("part"), F.col("family").alias("word")))
    names = seen.filter("pool = 'name'").select("instance", F.explode(parts).alias("p")).select("instance", "p.part", "p.word").distinct()
    of = [F.coalesce(F.max(F.when(F.col("part") == p, F.col("share"))), F.lit(0.0)).alias(p) for p in ("given_lower", "family_lower")]
    seen = seen.join(apart(names.join(apart(share, "word"), "word").groupBy("instance").agg(*of), "instance"), "instance", "left").fillna(0.0, ["given_lower", "family_lower"])
    initial = F.concat_ws("", F.slice("left", 1, 2)).isin(".m", "m^") & (F.col("family_lower") >= COMMON)
    doubtful = (F.col("pool") == "name") & (F.col("seed") == "person") & ((F.col("given_lower") + F.col("family_lower") > 1) | initial)
    return durable(seen.withColumn("seed", F.when(~F.coalesce(doubtful, F.lit(False)), F.col("seed"))))


def find_personal(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """``ident, kind, found, at`` of each piece of personal information; ``at`` is its first character's place.

    ``found`` is exactly as written. Null and empty texts have none. A corpus without any candidate gives no rows.
    Names of more than two words come from overlapping pairs, which are joined per document.
    """
    seen = candidates_of(docs, ident, text)
    labels = bootstrap(seen).filter(F.col("label").isin(*KINDS) | F.col("more_given") | F.col("more_family"))
    spans = durable(seen.join(labels, "instance").select(ident, "label", "found", "at", "form", "more_given", "more_family"))
    others = spans.filter(F.col("label").isin(*KINDS) & (F.col("label") != "person")).select(ident, F.col("label").alias("kind"), "found", "at")
    is_name = F.coalesce(F.col("label") == "person", F.lit(False))
    pairs = spans.filter(is_name | F.col("more_given") | F.col("more_family"))
    pair = F.struct("at", "found", is_name.alias("name"), (F.col("form") == "reversed").alias("reversed"), "more_given", "more_family")
    names = pairs.groupBy(ident).agg(F.collect_list(pair).alias("_pairs"), F.max(is_name).alias("_any")).filter("_any")

    @F.pandas_udf("array<struct<at int, found string>>")
    def whole(column: pd.Series) -> pd.Series:
        return column.map(whole_names)

    names = names.select(ident, F.explode(whole("_pairs")).alias("p"))
    return others.unionByName(names.select(ident, F.lit("person").alias("kind"), "p.found", "p.at"))


def whole_names(pairs) -> list[tuple[int, str]]:
    """``at, found`` of the names of one text from its overlapping pairs, each the longest that they make.

    A pair that is no name by itself lengthens one to the left by a given name, or to the right by a family name. A
    reversed name between two others, as in a list, is none, and what was taken for its initial may be a title.
    """
    pairs = sorted(pairs, key=lambda p: (p["at"], -len(p["found"])))
    spans = [(p["at"], p["at"] + len(p["found"])) for p in pairs]
    taken = [bool(p["name"]) for p in pairs]
    start = None
    for i in range(len(pairs) - 1, -1, -1):
        a, b = spans[i]
        taken[i] = taken[i] or bool(pairs[i]["more_given"]) and start is not None and a < start < b
        if taken[i]:
            start = a
    reach = 0
    for i, (a, b) in enumerate(spans):
        taken[i] = taken[i] or bool(pairs[i]["more_family"]) and a < reach < b
        if taken[i]:
            reach = max(reach, b)
    plain = [spans[i] for i in range(len(pairs)) if taken[i] and not pairs[i]["reversed"]]
    starts, ends, last = [a for a, _ in plain], [], 0
    for _, b in plain:
        ends.append(last := max(last, b))
    out: list[list] = []
    for i, (a, b) in enumerate(spans):
        if not taken[i]:
            continue
        if pairs[i]["reversed"] and (k := bisect_left(starts, a)) and ends[k - 1] > a and bisect_right(starts, a) < bisect_left(starts, b):
            continue
        if out and pairs[i]["reversed"] and personal_shapes.is_title(out[-1][1][: a - out[-1][0]]):
            out[-1] = [a, pairs[i]["found"]]
        elif out and a < out[-1][0] + len(out[-1][1]):
            out[-1][1] += pairs[i]["found"][out[-1][0] + len(out[-1][1]) - a :]
        else:
            out.append([a, pairs[i]["found"]])
    return [(a, f) for a, f in out]


def redact(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """``ident, text`` with every piece of personal information replaced by ``[KIND]``; all else stays as it is.

    Overlapping pieces are replaced as one, by the kind of the one that starts first, then of the longer one. Documents without any keep
    their text, null and empty ones included. Pieces are gathered per document, which holds no more of them than
    its own text has characters.
    """
    spans = find_personal(docs, ident, text).select(ident, "kind", "at", F.length("found").alias("n")).distinct()
    per_doc = spans.groupBy(ident).agg(F.sort_array(F.collect_list(F.struct("at", (-F.col("n")).alias("m"), "kind"))).alias("_spans"))

    @F.pandas_udf("string")
    def replace(texts: pd.Series, spans: pd.Series) -> pd.Series:
        def one(t: str | None, found) -> str | None:
            if t is None or found is None:
                return t
            out, done = [], 0
            for s in found:
                if s["at"] >= done:
                    out += [t[done : s["at"]], f"[{s['kind'].upper()}]"]
                done = max(done, s["at"] - s["m"])
            return "".join(out) + t[done:]

        return pd.Series([one(t, s) for t, s in zip(texts, spans, strict=True)])

    return docs.select(ident, text).join(per_doc, ident, "left").select(ident, replace(text, "_spans").alias(text))
