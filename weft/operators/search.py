"""Free-text queries over the graph: ranking nodes, choosing seeds, cutting an answer to a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions import text as T
from weft.functions import vocab
from weft.operators import degree as D
from weft.operators.traverse import MAX_DEPTH, bfs, dfs, hub_cutoff, walked
from weft.runtime import materialize

#: What a match is worth, whole-query matches ten times as much.
EXACT, PREFIX, PART, SOURCE = 1000.0, 100.0, 1.0, 0.5
#: Seeds at most, the share of the top score that further seeds need, characters a token, and the token budget.
SEEDS, GAP, CHARS, BUDGET = 3, 0.2, 3, 2000


def prepared(nodes: DataFrame) -> DataFrame:
    """nodes with the forms of their labels that terms are compared with."""
    norm = F.lower(T.plain_letters(F.col("label")))
    return nodes.withColumn("norm", norm).withColumn("bare", F.regexp_replace(norm, r"[()]+$", "")).withColumn("tokens", F.array_join(T.search_tokens(F.col("label")), " ")).withColumn("source", F.lower("source_file"))


def terms_of(question: str) -> list[str]:
    """Searchable terms of a question, in order, each once; stop words only where nothing else is left."""
    import re
    import unicodedata

    words = [w for w in re.findall(r"\w+", question.lower()) if not re.fullmatch("[a-z]{1,2}", w)]
    kept = [w for w in words if w not in vocab.STOPWORDS] or words
    plain = ["".join(c for c in unicodedata.normalize("NFKD", w) if not unicodedata.combining(c)) for w in kept]
    return list(dict.fromkeys(plain))


def idf(nodes: DataFrame, terms: list[str]) -> DataFrame:
    """One row: the weight ln(1 + N / (1 + df)) of each term (columns w0, w1, ...), df counting labels that contain it."""
    p = prepared(nodes)
    n = F.greatest(F.count(F.lit(1)), F.lit(1))
    return p.agg(*[F.log(1 + n / (1 + F.count_if(F.col("norm").contains(t)))).alias(f"w{i}") for i, t in enumerate(terms)])


def score(nodes: DataFrame, terms: list[str]) -> DataFrame:
    """id, label, score of nodes that match any term, and the score of each term by itself (s0, s1, ...).

    Exact and prefix matches of single terms are scaled by the square of the share of terms that match. All terms are scored
    in one pass over the nodes; the weights come from another, as one row that is broadcast.
    """
    if not terms:
        return nodes.select("id", "label", F.lit(0.0).alias("score")).limit(0)
    p = prepared(nodes).crossJoin(F.broadcast(idf(nodes, terms)))  # one row
    joined = " ".join(terms)
    top = F.greatest(*[F.col(f"w{i}") for i in range(len(terms))]) if len(terms) > 1 else F.col("w0")
    norm, bare, tokens = F.col("norm"), F.col("bare"), F.col("tokens")

    def whole(t: str, w: Column) -> Column:
        same = (norm == t) | (bare == t) | (tokens == t) | (F.lower("id") == t)
        begins = norm.startswith(t) | bare.startswith(t) | tokens.startswith(t)
        return F.when(same, EXACT * 10 * w).when(begins, PREFIX * 10 * w).otherwise(0.0)

    flat, tiered, matched, single = F.lit(0.0), F.lit(0.0), F.lit(0), []
    for i, t in enumerate(terms):
        w = F.col(f"w{i}")
        tier = F.when((norm == t) | (bare == t), EXACT * w).when(norm.startswith(t) | bare.startswith(t), PREFIX * w).otherwise(0.0)
        part = F.when((tier == 0) & norm.contains(t), PART * w).otherwise(0.0)
        source = F.when(F.col("source").contains(t), SOURCE * w).otherwise(0.0)
        flat, tiered, matched = flat + part + source, tiered + tier, matched + norm.contains(t).cast("int")
        single.append((whole(t, w) + tier + part + source).alias(f"s{i}"))
    total = whole(joined, top) + flat + tiered * F.pow(matched / len(terms), F.lit(2))
    return p.select("id", "label", "norm", total.alias("score"), *single)


def ranked(nodes: DataFrame, terms: list[str], n: int = 20) -> DataFrame:
    """id, label, score of the n best nodes: by score, then the shorter label, then the id."""
    return score(nodes, terms).where("score > 0").select("id", "label", "score").orderBy(F.desc("score"), F.length("label"), "id").limit(n)


def best_per_term(nodes: DataFrame, edges: DataFrame, terms: list[str]) -> DataFrame:
    """term and id of the node that scores best for each term: ties by degree, then the shorter label, then the id."""
    scores = score(nodes, terms)
    rows = scores.select("id", "label", F.explode(F.array(*[F.struct(F.lit(t).alias("term"), F.col(f"s{i}").alias("s")) for i, t in enumerate(terms)])).alias("e"))
    rows = rows.select("id", "label", "e.term", "e.s").where("s > 0")
    top = rows.groupBy("term").agg(F.max("s").alias("s"))  # the few that share the top score
    rows = D.with_degree(rows.join(F.broadcast(top), ["term", "s"]), edges)
    return rows.groupBy("term").agg(F.min_by("id", F.struct(-F.col("degree"), F.length("label"), F.col("id"))).alias("id"))


def pick_seeds(nodes: DataFrame, edges: DataFrame, terms: list[str]) -> list[str]:
    """Up to SEEDS of the best nodes, with distinct labels and GAP of the top score at least, and one for each term."""
    rows = score(nodes, terms).where("score > 0")
    # the best of each label are enough; of these the first few
    best = rows.groupBy("norm").agg(F.max(F.struct("score", (-F.length("label")).alias("l"))).alias("m"), F.min_by("id", F.struct(-F.col("score"), F.length("label"), F.col("id"))).alias("id"))
    first = best.select("id", "norm", F.col("m.score").alias("score"), F.col("m.l").alias("l")).orderBy(F.desc("score"), F.desc("l"), "id").limit(SEEDS).collect()
    seeds = [r["id"] for r in first if r["score"] >= first[0]["score"] * GAP]
    labels = {r["norm"] for r in first if r["id"] in seeds}
    extra = best_per_term(nodes, edges, terms).join(prepared(nodes).select("id", "norm"), "id").orderBy("term").collect()  # one row a term
    for row in extra:
        if row["id"] not in seeds and row["norm"] not in labels:
            seeds.append(row["id"])
            labels.add(row["norm"])
    return seeds


def pick_endpoint(nodes: DataFrame, text: str) -> DataFrame:
    """One row (id, label): the best-ranked node whose label has all of the text's words, else the best-ranked one."""
    terms = terms_of(text)
    rows = score(nodes, terms).where("score > 0")
    all_words = F.size(F.array_except(F.array(*map(F.lit, terms)), T.search_tokens(F.col("label")))) == 0
    return rows.orderBy(F.desc(all_words), F.desc("score"), F.length("label"), "id").limit(1).select("id", "label")


def _asked(nodes: DataFrame, edges: DataFrame, question: str, depth: int, deep: bool) -> tuple[DataFrame, DataFrame, int]:
    """id and hop of what a question is about, the edges of the contexts that it names, and the hub cutoff there."""
    spark = nodes.sparkSession
    seeds = pick_seeds(nodes, edges, terms_of(question))
    contexts = spark.range(1).select(T.context_filters(F.lit(question)).alias("c")).first()["c"]
    links = edges.where(F.col("context").isin(*contexts)) if contexts else edges
    cutoff = hub_cutoff(nodes, links)
    if deep:
        return spark.createDataFrame([(i, n) for i, n in dfs(links, seeds, min(depth, MAX_DEPTH), cutoff=cutoff)] if seeds else [], "id string, hop int"), links, cutoff
    return bfs(nodes, links, spark.createDataFrame([(s,) for s in seeds], "id string"), depth, cutoff), links, cutoff


def query_subgraph(nodes: DataFrame, edges: DataFrame, question: str, depth: int = 2, deep: bool = False) -> DataFrame:
    """id, label, hop of what a question is about: seeds, and what is near them over edges of the contexts that it names.

    deep: depth first instead of level by level; then hop is the depth at which a node was visited.
    """
    seen, _, _ = _asked(nodes, edges, question, depth, deep)
    return seen.join(nodes.select("id", "label"), "id").select("id", "label", "hop")


def answer(nodes: DataFrame, edges: DataFrame, question: str, depth: int = 2, tokens: int = BUDGET, deep: bool = False) -> DataFrame:
    """place, id, line: the nodes of an answer, then the edges walked, then, if not all fit, a line that says so.

    Edges follow in the order of their hops only where all nodes fit, as far as the rest of the budget goes.
    """
    seen, links, cutoff = _asked(nodes, edges, question, depth, deep)
    seen = materialize(seen.join(nodes.select("id", "label"), "id").select("id", "label", "hop"), "answer")
    return with_links(nodes, links, seen, within_budget(seen, edges, tokens), cutoff, tokens)


def with_links(nodes: DataFrame, edges: DataFrame, seen: DataFrame, shown: DataFrame, cutoff: int, tokens: int = BUDGET) -> DataFrame:
    """shown (place, id, line) and after it the lines of the edges walked to get seen (id, label, hop), and of what is cut.

    An edge's id is null. Two counts and at most as many lines as the budget holds are read on the driver.
    """
    spark = seen.sparkSession
    shown = materialize(shown, "shown")
    total, told = seen.count(), shown.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("line") + 1), F.lit(0)).alias("chars")).first()
    label = lambda end, name: seen.select(F.col("id").alias(end), F.col("label").alias(name))
    steps = walked(nodes, edges, seen, cutoff).join(label("source", "_s"), "source").join(label("target", "_t"), "target")
    context = F.when(F.coalesce("context", F.lit("")) != "", F.concat(F.lit(" context="), "context")).otherwise("")
    line = F.concat(F.lit("EDGE "), "_s", F.lit(" --"), "relation", F.lit(" ["), F.coalesce("confidence", F.lit("")), context, F.lit("]--> "), "_t")
    steps = materialize(steps.select("hop", "source", "target", "relation", line.alias("line")).where("line IS NOT NULL").distinct(), "steps")
    n_steps, room = steps.count(), tokens * CHARS - told["chars"]
    more: list[str] = []
    if told["n"] == total:
        # no line is shorter than its frame, so this many rows are more than fit
        for row in steps.orderBy("hop", "source", "target", "relation", "line").limit(max(0, room // 12) + 1).toLocalIterator():
            if len(row["line"]) + 1 > room:
                break
            room -= len(row["line"]) + 1
            more.append(row["line"])
    if told["n"] < total or len(more) < n_steps:
        more.append(f"... {told['n']} of {total} nodes and {len(more)} of {n_steps} edges fit into {tokens} tokens; ask a narrower question or raise the budget")
    rest = spark.createDataFrame([(told["n"] + i + 1, None, text) for i, text in enumerate(more)], "place int, id string, line string")
    return shown.select("place", "id", "line").union(rest)


def within_budget(rows: DataFrame, edges: DataFrame, tokens: int = BUDGET) -> DataFrame:
    """The lines of an answer: place, id, line, of rows (id, label, hop): seeds first and always, then by hop, degree and id,
    as many as the budget of CHARS characters a token holds.

    Lines are numbered in one sort of what a budget can hold at most, not of all rows.
    """
    line = F.concat(F.lit("NODE "), "label", F.lit(" ["), "id", F.lit("]"))
    known = D.with_degree(rows, edges).withColumn("line", line)
    room = tokens * CHARS
    order = [F.col("hop"), F.desc("degree"), F.col("id")]
    # no line is shorter than its frame, so this many rows are more than fit
    first = known.where("hop > 0").orderBy(*order).limit(room // 8 + 1).union(known.where("hop = 0"))
    upto = F.sum(F.length("line") + 1).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    place = F.row_number().over(Window.orderBy(*order))
    return first.withColumn("upto", upto).withColumn("place", place).where((F.col("hop") == 0) | (F.col("upto") <= room)).select("place", "id", "line")


def explain(nodes: DataFrame, edges: DataFrame, node: str, n: int = 20) -> DataFrame:
    """direction, relation, id, label, degree, place of a node's links: the n whose other end has the highest degree."""
    out = edges.where(F.col("source") == node).select(F.lit("out").alias("direction"), "relation", F.col("target").alias("id"))
    into = edges.where(F.col("target") == node).select(F.lit("in"), "relation", "source")
    rows = D.with_degree(out.union(into).distinct().join(nodes.select("id", "label"), "id"), edges)
    best = rows.orderBy(F.desc("degree"), "id", "direction", "relation").limit(n)
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("degree"), "id", "direction", "relation"))).select("direction", "relation", "id", "label", "degree", "place")


def explain_rest(nodes: DataFrame, edges: DataFrame, node: str, n: int = 20, most: int = 20) -> DataFrame:
    """direction, source_file and links: a node's links that explain leaves out, by file; the most files with the most links.

    All links are counted by file, then the n that explain shows are taken off, so no task sorts all links of a hub.
    """
    file = F.coalesce(F.nullif("source_file", F.lit("")), F.lit("(unknown file)")).alias("source_file")
    out = edges.where(F.col("source") == node).select(F.lit("out").alias("direction"), "relation", F.col("target").alias("id"), file)
    into = edges.where(F.col("target") == node).select(F.lit("in"), "relation", "source", file)
    links = out.union(into).groupBy("direction", "relation", "id").agg(F.min("source_file").alias("source_file")).join(nodes.select("id"), "id", "left_semi")
    told = links.join(F.broadcast(explain(nodes, edges, node, n).select("direction", "relation", "id")), ["direction", "relation", "id"], "left_anti")  # n rows
    return told.groupBy("direction", "source_file").agg(F.count(F.lit(1)).alias("links")).orderBy(F.desc("links"), "direction", "source_file").limit(most)


def ambiguity(nodes: DataFrame, terms: list[str]) -> DataFrame:
    """One row: the best score, the next one and whether they are within a tenth of the best; null scores where there are none."""
    best = F.sort_array(F.collect_list("score"), asc=False)  # of two rows
    two = ranked(nodes, terms, 2).agg(best.alias("_s"))
    scores = two.select(F.try_element_at("_s", F.lit(1)).alias("top"), F.try_element_at("_s", F.lit(2)).alias("runner"))
    return scores.withColumn("ambiguous", F.coalesce((F.col("top") - F.col("runner")) / F.col("top") < 0.1, F.lit(False)))


def trigram_postings(nodes: DataFrame) -> DataFrame:
    """gram and id for each distinct piece of three characters of a label."""
    p = prepared(nodes)
    return p.select("id", F.explode(T.shingles(F.col("norm"))).alias("gram"))


def trigram_candidates(nodes: DataFrame, needle: str) -> DataFrame:
    """id of the nodes whose labels have all pieces of needle: those that may contain it."""
    grams = sorted({needle[i : i + 3] for i in range(len(needle) - 2)}) or [needle]
    hits = trigram_postings(nodes).where(F.col("gram").isin(*grams)).groupBy("id").count()
    return hits.where(F.col("count") == len(grams)).select("id")


def token_reduction(words: DataFrame, answer_chars: Column, default_words: int = 50) -> DataFrame:
    """words (words) as corpus tokens, and how many times more they are than an answer of so many characters."""
    corpus = F.floor(F.coalesce(F.sum("words"), F.lit(default_words)) * 100 / 75).cast("long")
    return words.agg(corpus.alias("corpus_tokens")).withColumn("answer_tokens", F.greatest(F.lit(1), F.floor(answer_chars / 4)).cast("long")).withColumn("reduction", F.round(F.col("corpus_tokens") / F.col("answer_tokens"), 1))


def slices(docs: DataFrame, most: int = 20_000) -> DataFrame:
    """doc_id, place, start, end of slices of texts, of at most `most` code points, that together are the text.

    A cut is at the last heading in reach, else the last blank line, else the last line end, else right there.
    """
    import re
    from collections.abc import Iterator

    import pyarrow as pa

    def cut(text: str) -> list[tuple[int, int]]:
        out, at = [], 0
        while len(text) - at > most:
            end = at + most
            part = text[at:end]
            heads = [m.start() + 1 for m in re.finditer(r"\n#{1,6} ", part)]
            blank, line = part.rfind("\n\n"), part.rfind("\n")
            step = heads[-1] if heads else blank + 2 if blank > 0 else line + 1 if line > 0 else most
            out.append((at, at + step))
            at += step
        return [*out, (at, len(text))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, i, a, b) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) for i, (a, b) in enumerate(cut(t or ""))]
            c = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.int64())], ["doc_id", "place", "start", "end"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, place int, start long, end long")


def pack(files: DataFrame, budget: int = 60_000) -> DataFrame:
    """path, tokens, directory, chunk of files (path, tokens): filled in the order of their paths, directory by directory.

    A chunk closes before the file that would take it over the budget. Each directory begins a chunk, so that directories
    are packed side by side.
    """
    from collections.abc import Iterator

    import pandas as pd

    rows = files.select("path", F.col("tokens").cast("long").alias("tokens"), F.array_join(T.parents(F.col("path")), "/").alias("directory"))
    rows = rows.repartition("directory").sortWithinPartitions("directory", "path")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, chunk, used = None, 0, 0
        for part in parts:
            chunks = []
            for directory, tokens in zip(part["directory"], part["tokens"], strict=True):
                if directory != here:
                    here, chunk, used = directory, 0, 0
                elif used + tokens > budget:
                    chunk, used = chunk + 1, 0
                used += tokens
                chunks.append(chunk)
            yield part.assign(chunk=chunks)

    return rows.mapInPandas(run, "path string, tokens long, directory string, chunk long")


