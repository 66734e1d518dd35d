"""What a question asks and whether the evidence covers it: constraints, locators, scope, lint and denial cues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridoc.functions.text import STOPWORDS, collapse, tokenize
from veridoc.operators.lineage import cut
from veridoc.operators.spans import match_offsets

# Addressable units, cue words, words a document has no reason to contain, rulings, second questions.
LOCATOR = r"(?i)\b((?:claim|section|paragraph|article|clause)\s+[0-9]{1,3}[a-zA-Z]?(?:\([a-z0-9]+\))?)"
DENIAL_CUES = ("incorrect", "erroneous", "mistaken", "overstated", "restated", "superseded", "corrected", "revalued")
NOT_CONTENT = tuple("it its they them their he she his her we us our you your i me my one ones there here thing things something anything please tell show give find".split())
RULING = r"(?i)\b(patentab(?:le|ility)|novel(?:ty)?|obvious(?:ness)?|invalid(?:ate|ity)?|infring(?:e|es|ing|ement)|freedom.to.operate|enforceab(?:le|ility)|anticipated|prior.art.against|claim.construction|means.plus.function)\b"
SECOND_ASK = r"(?i)\b(?:and|or|also)\b[^,?]{0,40}\b(?:who|what|when|where|which|how|why|whether|does|is|are|do)\b"
CUE_WINDOW = 160


def parse_locator(text: Column) -> Column:
    """The one unit a text names, as 'claim 6'; null if it names none or several."""
    hits = F.regexp_extract_all(text, F.lit(LOCATOR), 1)
    return F.when(F.size(hits) == 1, F.lower(F.regexp_replace(F.get(hits, F.lit(0)), r"\s+", " ")))


def coverage(constraints: DataFrame, cited: DataFrame) -> DataFrame:
    """constraints (answer_id, role, text, required) with `covered`: whether the answer's cited texts, joined in order
    (answer_id, ord, text), contain them, case and white space aside. Optional ones that are absent count as covered;
    locators are judged by check_scope and left out here."""
    blob = cited.groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("t"))
    blob = blob.select("answer_id", F.lower(collapse(F.array_join(F.transform("t", lambda x: x["text"]), " "))).alias("blob"))
    rows = constraints.where("role <> 'locator'").join(blob, "answer_id", "left")
    hit = F.coalesce(F.contains("blob", F.lower(collapse(F.col("text")))), F.lit(False))
    return rows.select(*constraints.columns, (hit | ~F.col("required")).alias("covered"))


def ancestors(units: DataFrame, rounds: int = 64) -> DataFrame:
    """(doc_id, name, depth, ancestor, char_start, char_end) of every unit's chain, itself first; cycles end it.

    units: doc_id, name, parent, char_start, char_end; of equal names the last by offset counts. Each round joins the
    open ends with their parents; the number of rounds is the depth of the forest, not its size.
    """
    last = Window.partitionBy("doc_id", "name").orderBy(F.desc("char_start"), F.desc("char_end"), F.desc("parent"))
    once = units.withColumn("r", F.row_number().over(last)).where("r = 1").drop("r")
    once = cut(once)
    step = once.select("doc_id", "name", F.lit(0).alias("depth"), F.col("name").alias("ancestor"), "char_start", "char_end", "parent", F.array("name").alias("seen"))
    out = step
    for depth in range(1, rounds):
        up = once.select("doc_id", F.col("name").alias("ancestor"), F.col("char_start").alias("s"), F.col("char_end").alias("e"), F.col("parent").alias("p"))
        step = step.drop("ancestor").withColumnRenamed("parent", "ancestor").where(F.col("ancestor").isNotNull() & ~F.array_contains("seen", F.col("ancestor"))).join(up, ["doc_id", "ancestor"])
        step = step.select("doc_id", "name", F.lit(depth).alias("depth"), "ancestor", F.col("s").alias("char_start"), F.col("e").alias("char_end"), F.col("p").alias("parent"), F.concat("seen", F.array("ancestor")).alias("seen"))
        step = cut(step)
        if step.isEmpty():
            break
        out = out.union(step)
    return out.drop("parent", "seen")


def check_scope(citations: DataFrame, chains: DataFrame) -> DataFrame:
    """Per locator (doc_id, name) and citation (cite_id, pos): whether it lies in the unit or one it incorporates.

    citations: cite_id, doc_id, name, pos. `resolved` says whether the unit exists."""
    hit = citations.join(chains, ["doc_id", "name"], "left")
    inside = (F.col("char_start") <= F.col("pos")) & (F.col("pos") < F.col("char_end"))
    return hit.groupBy(*citations.columns).agg(F.coalesce(F.bool_or(F.col("depth").isNotNull()), F.lit(False)).alias("resolved"), F.coalesce(F.bool_or(inside), F.lit(False)).alias("in_unit"))


def lint(questions: DataFrame, vocabulary: DataFrame, units: DataFrame | None = None) -> DataFrame:
    """(question_id, severity, kind, terms): words no document has, units that aren't there, rulings asked for, two
    questions in one. vocabulary: distinct `term`. An empty vocabulary raises no absent terms."""
    terms = questions.select("question_id", F.posexplode(tokenize(F.col("question"))).alias("n", "term"))
    terms = terms.where(~F.col("term").isin(*STOPWORDS, *NOT_CONTENT) & ~F.col("term").rlike("^[0-9]+$")).groupBy("question_id", "term").agg(F.min("n").alias("n"))
    absent = terms.join(vocabulary.select("term").distinct(), "term", "left_anti").groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("n", "term"))).alias("t"))
    some = vocabulary.limit(1).select(F.lit(1).alias("some"))
    out = absent.crossJoin(F.broadcast(some)).select("question_id", F.lit(1).alias("severity"), F.lit("absent-terms").alias("kind"), F.transform("t", lambda x: x["term"]).alias("terms"))
    none = F.array().cast("array<string>")
    if units is not None:
        named = questions.select("question_id", parse_locator(F.col("question")).alias("name")).where("name is not null")
        lost = named.join(units.select("name").distinct(), "name", "left_anti")
        out = out.union(lost.select("question_id", F.lit(1), F.lit("no-such-unit"), F.array("name")))
    ruling = questions.select("question_id", F.regexp_extract("question", RULING, 1).alias("m")).where("m <> ''")
    out = out.union(ruling.select("question_id", F.lit(2), F.lit("adjudication"), F.array("m")))
    return out.union(questions.where(F.col("question").rlike(SECOND_ASK)).select("question_id", F.lit(3), F.lit("compound"), none))


def cue_offsets(texts: DataFrame, cues: tuple[str, ...] = DENIAL_CUES) -> DataFrame:
    """(id, cue, cue_start) of every cue word."""
    shape = r"(?i)\b(?:" + "|".join(cues) + r")\b"
    return match_offsets(texts, shape, ("id",)).select("id", F.lower("found").alias("cue"), F.col("at").alias("cue_start"))


def denial_cue_hits(texts: DataFrame, atoms: DataFrame, window: int = CUE_WINDOW) -> DataFrame:
    """(id, cue, cue_start, atom_start, distance): each cue with its nearest atom (id, atom_start) in the window.

    Cues look into the one or two blocks of offsets that their window meets, so the join has equality keys; of equally
    near atoms the first counts. Both sides are shuffled: Spark takes what was exploded for as small as its source and
    would broadcast it."""
    block = lambda c: F.floor(c / (2 * window + 1))
    cues = cue_offsets(texts).withColumn("block", F.explode(F.sequence(block(F.col("cue_start") - window), block(F.col("cue_start") + window))))
    near = atoms.select("id", "atom_start", block(F.col("atom_start")).alias("block"))
    hits = cues.join(near.hint("merge"), ["id", "block"]).withColumn("distance", F.abs(F.col("cue_start") - F.col("atom_start"))).where(F.col("distance") <= window)
    best = F.min(F.struct("distance", "atom_start"))
    return hits.groupBy("id", "cue", "cue_start").agg(best.alias("b")).select("id", "cue", "cue_start", "b.atom_start", "b.distance")


def cited_atoms(answers: DataFrame) -> DataFrame:
    """(answer_id, s, ord, doc_id, char_start, char_end) of the atoms of every sentence and then its operands."""
    sents = answers.select("answer_id", F.posexplode("sentences").alias("s", "sent"))
    none = F.slice("sent.atoms", 1, 0)
    operands = F.flatten(F.transform("sent.derived", lambda d: d["operands"]))
    rows = sents.select("answer_id", "s", F.posexplode(F.concat(F.coalesce("sent.atoms", none), F.coalesce(operands, none))).alias("ord", "a"))
    return rows.select("answer_id", "s", "ord", "a.doc_id", "a.char_start", "a.char_end")


def answer_coverage(answers: DataFrame, constraints: DataFrame, spans: DataFrame, units: DataFrame) -> DataFrame:
    """constraints (answer_id, role, text, required) with `covered`, judged by what the answer cites: the spans that hold
    its atoms and operands, in order, and for locators whether one of them lies in the unit or one it incorporates."""
    from veridoc.operators.spans import containing_spans

    atoms = cited_atoms(answers)
    held = containing_spans(spans, atoms.select("doc_id", F.col("char_start").alias("pos")).distinct())
    cited = atoms.join(held.select("doc_id", F.col("pos").alias("char_start"), F.col("span_text").alias("text")), ["doc_id", "char_start"])
    cited = cited.select("answer_id", F.struct("s", "ord").alias("ord"), "text")
    words = coverage(constraints, cited)
    asked = constraints.where("role = 'locator'").withColumn("name", parse_locator(F.col("text")))
    where = atoms.select("answer_id", "doc_id", F.col("char_start").alias("pos")).distinct().join(asked.select("answer_id", "name").distinct(), "answer_id")
    inside = check_scope(where.select(F.col("answer_id").alias("cite_id"), "doc_id", "name", "pos"), ancestors(units)).groupBy(F.col("cite_id").alias("answer_id"), "name").agg(F.bool_or("in_unit").alias("in_unit"))
    located = asked.join(inside, ["answer_id", "name"], "left").select(*constraints.columns, (F.coalesce("in_unit", F.lit(False)) | ~F.col("required")).alias("covered"))
    return words.unionByName(located)


def claim_units(docs: DataFrame, kinds: DataFrame) -> DataFrame:
    """Claims of documents whose kind (doc_id, kind) is patent as units (doc_id, name, parent, char_start, char_end); other
    documents have none, so a locator into them isn't resolved."""
    from veridoc.operators.patents import parse_claims

    named = lambda n: F.concat(F.lit("claim "), F.col(n).cast("string"))
    patents = docs.join(kinds.where("kind = 'patent'").select("doc_id").distinct(), "doc_id", "left_semi")
    return parse_claims(patents).select("doc_id", named("number").alias("name"), F.when(F.col("depends_on").isNotNull(), named("depends_on")).alias("parent"), "char_start", "char_end")


def cue_notes(answers: DataFrame, spans: DataFrame, window: int = CUE_WINDOW) -> DataFrame:
    """(answer_id, cue): denial cues near an atom or operand in the span that holds it; they block nothing."""
    from veridoc.operators.spans import containing_spans

    atoms = cited_atoms(answers)
    held = containing_spans(spans, atoms.select("doc_id", F.col("char_start").alias("pos")).distinct()).where("span_id is not null")
    texts = held.select(F.col("span_id").alias("id"), F.col("span_text").alias("text")).distinct()
    placed = held.select(F.col("span_id").alias("id"), "doc_id", "pos", (F.col("pos") - F.col("char_start")).alias("atom_start"))
    # every atom near a cue counts, not only the nearest
    near = cue_offsets(texts).withColumn("block", F.floor(F.col("cue_start") / window))
    listed = placed.withColumn("block", F.explode(F.sequence(F.floor(F.col("atom_start") / window) - 1, F.floor(F.col("atom_start") / window) + 1)))
    hits = near.join(listed.hint("merge"), ["id", "block"]).where(F.abs(F.col("cue_start") - F.col("atom_start")) <= window).select("doc_id", F.col("pos").alias("char_start"), "cue").distinct()
    return atoms.join(hits, ["doc_id", "char_start"]).select("answer_id", "cue").distinct()


def cue_census(texts: DataFrame, figure: str = r"[0-9][0-9,.%]*", window: int = CUE_WINDOW) -> DataFrame:
    """(cue, n, near_figures): how often cues occur, and how often a figure is near."""
    cues = cue_offsets(texts)
    figures = match_offsets(texts, figure, ("id",)).select("id", F.col("at").alias("atom_start"))
    hits = denial_cue_hits(texts, figures, window).groupBy("cue").agg(F.count("*").alias("near_figures"))
    return cues.groupBy("cue").agg(F.count("*").alias("n")).join(hits, "cue", "left").select("cue", "n", F.coalesce("near_figures", F.lit(0)).cast("long").alias("near_figures"))
