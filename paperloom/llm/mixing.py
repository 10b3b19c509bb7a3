"""Mixing sources to target weights by iterative proportional fitting; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, free_names, materialize

DIMENSIONS = ("source", "lang", "topic")
#: A dimension's target shares are its token shares to this power, scaled to 1: below 1 small groups gain.
TEMPERATURE = {"source": 0.5, "lang": 0.7, "topic": 0.5}
#: Most sweeps; they end earlier when no factor moved by more than TOLERANCE, relatively.
SWEEPS, TOLERANCE, BUDGET = 20, 1e-11, 0.5
#: Cells that are raked within one row; more of them are raked by joins and sums.
SMALL = 50_000


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def default_topic(text: Column, n_tokens: Column) -> Column:
    """Kind of a text by its shape, for tables without topics."""
    return F.when(F.contains(text, F.lit(" | ")), "table").when(n_tokens < 100, "note").when(n_tokens < 1000, "article").otherwise("book")


def described(docs: DataFrame, topic: str | None, names: list[str]) -> DataFrame:
    """``docs`` with what mixing needs: source, lang, topic and n_tokens under four ``names``."""
    text = F.col("text").cast("string")
    source, lang, kind, n = names
    out = docs.withColumn(n, token_count(text))
    group = F.col(topic).cast("string") if topic else default_topic(text, F.col(n))
    blank = F.lit("")
    return out.withColumns({source: F.coalesce(F.col("source").cast("string"), blank), lang: F.coalesce(F.col("lang").cast("string"), blank), kind: F.coalesce(group, blank)})


def _targets(cells: DataFrame, dim: str, wanted: dict[str, float] | None) -> DataFrame:
    """(dim, t): shares that add up to 1 over the dimension's groups that have tokens."""
    sums = cells.groupBy(dim).agg(F.sum("tokens").cast("double").alias("s"))
    if wanted:
        pick = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in wanted.items() for x in kv)), F.col(dim)), F.lit(0.0))
        raw = sums.withColumn("r", pick.cast("double"))
    else:
        raw = sums.withColumn("r", F.pow("s", F.lit(TEMPERATURE[dim])))
    whole = raw.agg(F.sum("r").alias("all"))
    return raw.join(F.broadcast(whole)).select(dim, (F.col("r") / F.col("all")).alias("t"))  # one row


def factors(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, sweeps: int = SWEEPS) -> dict[str, DataFrame]:
    """For each dimension its written table (dim, f): a cell's fitted weight is its tokens times its three factors.

    Gauss-Seidel raking: a dimension's factors are its targets over its sums of tokens
    times the other factors. State is three tables of one row a group. Sums have a
    map-side combine, so a large group is no large task, and whether a factor table is
    broadcast is decided by Spark from its written size. One number a step reaches the
    driver: by how much a factor moved.
    """
    goals = {d: materialize(_targets(cells, d, (targets or {}).get(d))) for d in DIMENSIONS}
    now = {d: materialize(goals[d].select(d, F.lit(1.0).alias("f"))) for d in DIMENSIONS}
    for _ in range(sweeps):
        moved = 0.0
        for d in DIMENSIONS:
            x = cells.select(*DIMENSIONS, F.col("tokens").cast("double").alias("w"))
            for o in DIMENSIONS:
                if o != d:
                    x = x.join(now[o], o).withColumn("w", F.col("w") * F.col("f")).drop("f")
            sums = x.groupBy(d).agg(F.sum("w").alias("s"))
            new = goals[d].join(sums, d).join(now[d].withColumnRenamed("f", "old"), d)
            new = materialize(new.select(d, F.when(F.col("s") > 0, F.col("t") / F.col("s")).otherwise(0.0).alias("f"), "old"))
            step = new.agg(F.max(F.abs(F.col("f") - F.col("old")) / F.greatest("f", "old", F.lit(1e-300)))).first()[0]
            discard(now[d])
            written, now[d] = new._written, new.select(d, "f")
            now[d]._written = written
            moved = max(moved, step or 0.0)
        if moved <= TOLERANCE:
            break
    discard(*goals.values())
    return now


def _folded(cells: DataFrame, targets: dict[str, dict[str, float]] | None, sweeps: int) -> DataFrame:
    """``rake`` for a bounded number of cells: all sweeps are one fold over one row that holds them."""
    listed = cells.agg(F.sort_array(F.collect_list(F.struct(*DIMENSIONS, "tokens"))).alias("c")).select(F.posexplode("c").alias("i", "x"))
    sides = F.array(*(F.struct(F.lit(k).alias("dim"), F.col(f"x.{d}").alias("name")) for k, d in enumerate(DIMENSIONS)))
    groups = listed.select("i", "x", F.explode(sides).alias("s")).groupBy("s.dim", "s.name").agg(F.sum("x.tokens").cast("double").alias("s"), F.collect_list(F.struct("i", *(F.col(f"x.{c}") for c in (*DIMENSIONS, "tokens")))).alias("members"))
    want = None
    for k, d in enumerate(DIMENSIONS):
        given = (targets or {}).get(d)
        share = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in given.items() for x in kv)), F.col("name")), F.lit(0.0)).cast("double") if given else F.pow("s", F.lit(TEMPERATURE[d]))
        want = F.when(F.col("dim") == k, share) if want is None else want.when(F.col("dim") == k, share)
    row = groups.withColumn("want", want).agg(F.sort_array(F.collect_list(F.struct("dim", "name", "want", "members"))).alias("g"))
    of_dim = lambda k: F.filter("g", lambda g: g["dim"] == k)
    row = row.select(F.array(*map(of_dim, range(len(DIMENSIONS)))).alias("g"))
    total = lambda of: F.aggregate(of, F.lit(0.0), lambda a, g: a + g["want"])
    places = F.transform("g", lambda of: F.get(F.transform(F.array(total(of)), lambda whole: F.transform(of, lambda g: F.struct((g["want"] / whole).alias("t"), F.transform(g["members"], lambda m: m["i"]).alias("at")))), 0))
    # written, so that the fold reads one row of arrays
    row = materialize(row.select(F.array_sort(F.flatten(F.transform(F.get("g", 0), lambda g: g["members"]))).alias("c"), places.alias("places")))

    def scaled(w: Column, step: Column) -> Column:
        def group(g: Column) -> Column:
            whole = F.aggregate(g["at"], F.lit(0.0), lambda a, i: a + F.get(w, i))
            once = F.transform(F.array(whole), lambda s: F.transform(g["at"], lambda i: F.struct(i.alias("i"), F.when(s > 0, F.get(w, i) * g["t"] / s).otherwise(0.0).alias("w"))))
            return F.get(once, 0)

        return F.transform(F.array_sort(F.flatten(F.transform(F.get("places", F.pmod(step, F.lit(len(DIMENSIONS)))), group))), lambda x: x["w"])

    start = F.transform("c", lambda x: x["tokens"].cast("double"))
    fitted = F.aggregate(F.expr(f"sequence(0, {len(DIMENSIONS) * sweeps - 1})"), start, scaled) if sweeps else start
    out = materialize(row.select(F.explode(F.arrays_zip("c", fitted.alias("w"))).alias("z")).select(*(F.col(f"z.c.{c}").alias(c) for c in (*DIMENSIONS, "tokens")), "z.w"))
    discard(row)
    return out


def rake(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, sweeps: int = SWEEPS) -> DataFrame:
    """(source, lang, topic, tokens, w): token weights whose marginals approach the targets; ``w`` adds up to 1.

    ``cells`` has one row per combination, with its tokens. A sweep scales the weights to
    each dimension's targets in turn. Cells without tokens and targets of groups that
    have none are dropped. Up to SMALL cells are raked within one row, which takes one job
    for all sweeps; more by factor tables (``factors``). Both give the same weights.
    """
    cells = materialize(cells.where("tokens > 0").select(*DIMENSIONS, "tokens"))
    if cells.count() <= SMALL:
        out = _folded(cells, targets, sweeps)
        discard(cells)
        return out
    fitted = factors(cells, targets, sweeps)
    out = cells.withColumn("w", F.col("tokens").cast("double"))
    for d in DIMENSIONS:
        out = out.join(fitted[d], d).withColumn("w", F.col("w") * F.col("f")).drop("f")
    out = materialize(out.select(*DIMENSIONS, "tokens", "w"))
    discard(cells, *fitted.values())
    return out


def calibrate(raked: DataFrame, budget: float = BUDGET) -> DataFrame:
    """(source, lang, topic, p): p = min(1, scale * w / tokens), with the scale at which ``budget`` of all tokens are expected.

    Cells that are wanted more than they can give are taken whole, and the rest of the
    budget is shared by the others. Setting such cells aside raises the scale, which may
    fill more cells; the steps end when none is added. A step is one sum over cells.
    """
    r = F.col("w") / F.col("tokens")
    scale, filled = 0.0, -1
    while True:
        full = (r * F.lit(scale) >= 1 - 1e-12) & (r > 0) if filled >= 0 else F.lit(False)
        n, taken, left, whole = raked.agg(F.count_if(full), F.sum(F.when(full, F.col("tokens"))), F.sum(F.when(~full, F.col("w"))), F.sum("tokens")).first()
        if n == filled or not left:
            break
        filled, scale = n, (whole * budget - (taken or 0)) / left
    p = F.least(F.lit(1.0), F.lit(scale) * r) if scale > 0 and left else F.lit(1.0)
    return raked.select(*DIMENSIONS, F.when(r > 0, p).otherwise(0.0).alias("p"))


def _uniform(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the id and the seed alone."""
    digits = F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f"/{seed}")).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / float(1 << 52)


def _with_probability(rows: DataFrame, names: list[str], p_name: str, targets: dict[str, dict[str, float]] | None, budget: float, sweeps: int) -> DataFrame:
    """``rows`` joined to their cell's probability. The join is on the cell; Spark broadcasts the written table where it is small, and splits skewed cells where it is not."""
    cells = materialize(rows.groupBy(*(F.col(n).alias(d) for n, d in zip(names, DIMENSIONS, strict=False))).agg(F.sum(names[3]).alias("tokens")))
    raked = rake(cells, targets, sweeps)
    p = materialize(calibrate(raked, budget).select(*(F.col(d).alias(n) for n, d in zip(names, DIMENSIONS, strict=False)), F.col("p").alias(p_name)))
    discard(cells, raked)
    return rows.join(p, names[:3], "left").withColumn(p_name, F.coalesce(p_name, F.lit(0.0)))


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, topic: str | None = None, budget: float = BUDGET, seed: str = "mix", sweeps: int = SWEEPS) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, probability, sampled for each row of ``docs``.

    Token weights of (source, lang, topic) cells are raked to target marginals, and a
    document is sampled with its cell's calibrated probability. ``targets`` gives shares
    by dimension and group; a dimension that it leaves out gets its token shares to the
    power in TEMPERATURE. Whether a row is sampled depends on doc_id and seed alone, so
    retries agree and equal ids are sampled together. Null source, lang or topic is the
    group ''. Rows of cells without tokens have probability 0. Other columns are ignored.
    """
    names = ["source_group", "lang_group", "topic_group", "n_tokens"]
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source", "lang", *([F.col(topic).cast("string").alias("given_topic")] if topic else []))
    rows = materialize(described(picked, "given_topic" if topic else None, names).select("doc_id", *names))
    out = _with_probability(rows, names, "p", targets, budget, sweeps)
    return out.select("doc_id", *(F.col(n).alias(d) for n, d in zip(names, DIMENSIONS, strict=False)), "n_tokens", F.round("p", 6).alias("probability"), (_uniform(F.col("doc_id"), seed) < F.col("p")).alias("sampled"))


def sample(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, topic: str | None = None, budget: float = BUDGET, seed: str = "mix", sweeps: int = SWEEPS) -> DataFrame:
    """The sampled rows of ``docs`` with all their columns and ``mix_probability`` (with underscores behind it where ``docs`` has that name)."""
    *names, p_name = free_names(docs, "source_group", "lang_group", "topic_group", "n_tokens", "p")
    out = _with_probability(described(docs, topic, names), names, p_name, targets, budget, sweeps).where(_uniform(F.col("doc_id"), seed) < F.col(p_name))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns), F.round(p_name, 6).alias(free_names(docs, "mix_probability")[0]))


def sql() -> str:
    """The same as ``mix`` over ``documents`` for DuckDB, sweep by sweep."""
    step = "w{i} AS MATERIALIZED (SELECT * EXCLUDE (w), CASE WHEN sum(w) OVER (PARTITION BY {d}) > 0 THEN w * t_{d} / sum(w) OVER (PARTITION BY {d}) ELSE 0 END AS w FROM w{j})"
    chain, i = [], 0
    for _ in range(SWEEPS):
        for d in DIMENSIONS:
            chain.append(step.format(i=i + 1, j=i, d=d))
            i += 1
    goals = ",\n".join(f"g_{d} AS (SELECT {d}, pow(sum(tokens), {TEMPERATURE[d]}) / sum(pow(sum(tokens), {TEMPERATURE[d]})) OVER () AS t_{d} FROM cells GROUP BY {d})" for d in DIMENSIONS)
    return rf"""
WITH n AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS n_tokens FROM documents),
d AS (SELECT doc_id, source, lang, n_tokens, CASE WHEN contains(text, ' | ') THEN 'table' WHEN n_tokens < 100 THEN 'note' WHEN n_tokens < 1000 THEN 'article' ELSE 'book' END AS topic FROM n),
cells AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM d GROUP BY 1, 2, 3 HAVING sum(n_tokens) > 0),
{goals},
w0 AS (SELECT c.*, t_source, t_lang, t_topic, tokens AS w FROM cells c JOIN g_source USING (source) JOIN g_lang USING (lang) JOIN g_topic USING (topic)),
{", ".join(chain)},
r AS (SELECT source, lang, topic, tokens, w, w / tokens AS r FROM w{i}),
f AS (SELECT *, coalesce(sum(tokens) OVER (ORDER BY r DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken,
             sum(w) OVER (ORDER BY r DESC, source, lang, topic ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, sum(tokens) OVER () AS whole FROM r),
s AS (SELECT max(k) AS k FROM (SELECT r, (whole * {BUDGET} - taken) / rest AS k FROM f) WHERE r > 0 AND k >= 0 AND k * r <= 1 + 1e-12),
p AS (SELECT source, lang, topic, least(1.0, coalesce(k * r, 1.0)) AS p FROM r, s)
SELECT doc_id, source, lang, topic, CAST(n_tokens AS BIGINT) AS n_tokens, round(coalesce(p, 0), 6) AS probability,
       CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '/mix'), 1, 13) AS BIGINT) / 4503599627370496.0 < coalesce(p, 0) AS sampled
FROM d LEFT JOIN p USING (source, lang, topic)
"""
