"""Registered queries of this subpackage, with DuckDB twins where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudloom.llm.collocations import COVER, MIN_COUNT, TOP, mine_collocations
from cloudloom.llm.decontaminate import find_leaks
from cloudloom.llm.exact_dedup import exact_groups
from cloudloom.llm.hard_negatives import mine_hard_negatives
from cloudloom.llm.language_id import fit_dictionaries, fold, identify
from cloudloom.llm.lm_score import score_texts
from cloudloom.llm.mixing import MAX_EPOCHS, WEIGHTS, mix_sources
from cloudloom.llm.ngram_join import ngram_jaccard_groups
from cloudloom.llm.secret_scan import KINDS, scan_secrets, train
from cloudloom.llm.sentencepiece_codec import encode_decode
from cloudloom.llm.substring_dedup import substring_dedup
from cloudloom.llm.suffix_dedup import suffix_dedup
from cloudloom.llm.url_filter import DEPTH, MAX_CHILDREN, MIN_LABELS, MIN_PAGES, PRIOR, PRIOR_WEIGHT, PURITY, Z, filter_urls

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers `fn(spark, sf_dir) -> DataFrame` under `name`."""

    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sha256(text: str):
    """Lower-case hex of the text in UTF-8."""
    return F.sha2(F.col(text).cast("binary"), 256)


def _repeats_sql(window: int) -> str:
    """Every word covered by a window of `window` words that starts at least twice."""
    return f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(ws) - {window - 1} + 1)) AS i, ws FROM w WHERE len(ws) >= {window}),
g AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + {window - 1}], ' ')) AS h FROM s),
d AS (SELECT doc_id, i FROM g WHERE h IN (SELECT h FROM g GROUP BY h HAVING count(*) > 1)),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + {window})) AS i FROM d),
p AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
k AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.i) AS kept, count(*) AS n FROM p ANTI JOIN c USING (doc_id, i) GROUP BY p.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)"""


LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op1_exact_dedup",
    f"""SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, {LOWER_SQL} AS t FROM documents) WINDOW w AS (PARTITION BY t)""",
)
def op1_exact_dedup(spark, sf_dir):
    """Groups of documents whose texts are equal but for the case of A-Z; the largest doc_id stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_groups(docs, keep="largest").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query(
    "op4_ngram_jaccard_join",
    f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER_SQL}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 80 * (a.n + b.n - k)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.doc_id WHERE e.y > r.root)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.root) AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN r USING (doc_id) GROUP BY ALL""",
)
def op4_ngram_jaccard_join(spark, sf_dir):
    """Groups of documents linked by a Jaccard similarity of at least 0.8 of their five-word shingles."""
    return ngram_jaccard_groups(table(spark, sf_dir, "documents"))


@query("op5_language_id")
def op5_language_id(spark, sf_dir):
    """Language of every document, learnt from three of four folds."""
    docs = table(spark, sf_dir, "documents")
    dictionaries = fit_dictionaries(docs.filter(fold("doc_id", 4) != 2))
    judged = identify(docs.select("doc_id", "text"), dictionaries)
    return judged.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


@query("op6_sentencepiece")
def op6_sentencepiece(spark, sf_dir):
    """Every document as ids of a public vocabulary, and back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return done.select("doc_id", "n_tokens", sha256("ids").alias("ids_sha256"), sha256("decoded").alias("decoded_sha256"))


@query("op7_secret_scan")
def op7_secret_scan(spark, sf_dir):
    """Secrets of every document: those of the fixed patterns, and those that the trained field adds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan_secrets(docs, train(docs))

    def digest(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("secrets", lambda s: s["kind"] != "crf")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(digest(base).cast("binary"), 256).alias("base_sha256"), digest(F.col("secrets")).alias("spans"))


@query("op8_lm_score")
def op8_lm_score(spark, sf_dir):
    """Scores of every document by a word model and a recurrent model, learnt from four of five folds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (fold("doc_id", 5) != 1).alias("learn"))
    scored = score_texts(docs, "learn")
    return scored.select("doc_id", F.coalesce(fold("doc_id", 5) == 1, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


#: Verdict, host and path; the longest fitting rule wins.
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def _url_sql() -> str:
    """Rules, and the template tree level by level over counts of segment lists."""
    ordered = sorted(URL_RULES, key=lambda r: (-len(r[1]), r[1]))
    parts = [(what, text, *text.split("/", 1)) for what, text in ordered]
    fits = [f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{rest}'))" for _, _, h, rest in parts]
    rule = " ".join(f"WHEN {f} THEN '{text}'" for f, (_, text, _, _) in zip(fits, parts))
    given = " ".join(f"WHEN {f} THEN '{what}'" for f, (what, _, _, _) in zip(fits, parts))
    smooth = f"(({{}}) + {PRIOR_WEIGHT}e0 * ({{}})) / (({{}}) + {PRIOR_WEIGHT}e0)"
    url = "regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', {})"
    ctes = [
        f"u AS (SELECT page_id, translate(coalesce({url.format(1)}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce({url.format(2)}, '') AS path FROM pages)",
        f"v AS (SELECT *, CASE {rule} END AS rule, CASE {given} END AS given, list_filter(string_split(path, '/'), lambda s: s <> '') AS parts FROM u)",
        f"w AS (SELECT *, list_transform(CASE WHEN len(parts) > {DEPTH} THEN list_concat(parts[1:{DEPTH - 1}], ['**']) ELSE parts END, "
        "lambda s: regexp_replace(regexp_replace(s, '^[0-9a-fA-F]{16,}', '%'), '[0-9]+', '#', 'g')) AS segments FROM v)",
        "s00 AS (SELECT host, segments, count(*) AS n, count(given) AS m, count(*) FILTER (WHERE given = 'block') AS b, '' AS template FROM w GROUP BY host, segments)",
        "hs AS (SELECT host, sum(m) AS hm, sum(b) AS hb, coalesce(nullif(regexp_extract(host, '[^.]+\\.[^.]+$', 0), ''), host) AS domain FROM s00 GROUP BY host)",
        f"ds AS (SELECT domain, {smooth.format('sum(hb)', f'{PRIOR}e0', 'sum(hm)')} AS share FROM hs GROUP BY domain)",
        f"hp AS (SELECT host, {smooth.format('hb', 'share', 'hm')} AS share FROM hs JOIN ds USING (domain))",
        "s0 AS (SELECT s00.*, share FROM s00 JOIN hp USING (host))",
    ]
    apart = "abs({0} / {1} - f{0} / f{1}) > " + f"{Z}e0 * sqrt(" + "f{0} / f{1} * (1 - f{0} / f{1}) / {1})"
    for i in range(1, DEPTH + 1):
        ctes += [
            f"n{i} AS (SELECT host, template, segments[{i}] AS child, sum(n) AS n, coalesce(sum(n) FILTER (WHERE len(segments) > {i}), 0) AS d, sum(m) AS m, sum(b) AS b, min(share) AS up "
            f"FROM s{i - 1} WHERE segments[{i}] IS NOT NULL GROUP BY host, template, child)",
            f"f{i} AS (SELECT *, count(*) OVER t AS k, sum(n) OVER t AS fn, sum(d) OVER t AS fd, sum(m) OVER t AS fm, sum(b) OVER t AS fb, NOT regexp_matches(child, '[#%*]') AS literal "
            f"FROM n{i} WINDOW t AS (PARTITION BY host, template))",
            f"a{i} AS (SELECT host, template, child, m, b, up, CASE WHEN literal AND k > {MAX_CHILDREN} THEN '*' WHEN literal AND k > 1 AND n >= {MIN_PAGES} AND NOT {apart.format('d', 'n')} "
            f"AND NOT CASE WHEN m >= {MIN_LABELS} AND m < fm THEN {apart.format('b', 'm')} ELSE false END THEN '~' ELSE child END AS name FROM f{i})",
            f"m{i} AS (SELECT host, template, name, {smooth.format('sum(b)', 'min(up)', 'sum(m)')} AS below FROM a{i} GROUP BY host, template, name)",
            f"s{i} AS (SELECT s.host, segments, n, s.m, s.b, CASE WHEN a.name IS NULL THEN s.template ELSE s.template || '/' || a.name END AS template, coalesce(below, share) AS share "
            f"FROM s{i - 1} s LEFT JOIN a{i} a ON s.host = a.host AND s.template = a.template AND s.segments[{i}] = a.child "
            f"LEFT JOIN m{i} g ON g.host = a.host AND g.template = a.template AND g.name = a.name)",
        ]
    ctes.append(f"q AS (SELECT host, segments, template, (sum(m) OVER (PARTITION BY host, template))::BIGINT AS labelled, share AS blocked_share FROM s{DEPTH})")
    return f"""WITH {", ".join(ctes)} SELECT page_id, host, path, rule, coalesce(given, CASE WHEN blocked_share >= {PURITY} THEN 'block' ELSE 'allow' END) AS verdict,
template, labelled, round(blocked_share, 6) AS blocked_share FROM w JOIN q USING (host, segments)"""


@query("op9_url_filter", _url_sql())
def op9_url_filter(spark, sf_dir):
    """Every page judged by the rules, or by the path templates of its host where no rule fits."""
    judged = filter_urls(table(spark, sf_dir, "pages"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "template", "labelled", F.round("blocked_share", 6).alias("blocked_share"))


def _without_repeats(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "n_words", "n_removed", sha256("kept").alias("kept_sha256"))


@query("op2_decontamination")
def op2_decontamination(spark, sf_dir):
    """Documents that hold a benchmark item, exactly or with up to a fifth of its words edited."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        (F.size("leaks") > 0).alias("contaminated"),
        F.size("leaks").cast("long").alias("n_items"),
        F.array_join(F.transform("leaks", lambda x: x["item"].cast("string")), ",").alias("item_ids"),
        F.array_min(F.transform("leaks", lambda x: x["distance"].cast("long"))).alias("least_distance"),
    )


@query("op3_suffix_dedup", _repeats_sql(50))
def op3_suffix_dedup(spark, sf_dir):
    """Passages of 50 words that occur more than once, taken out of every document."""
    return _without_repeats(suffix_dedup(table(spark, sf_dir, "documents")))


@query("op10_substring_dedup", _repeats_sql(35))
def op10_substring_dedup(spark, sf_dir):
    """Passages of 35 words that occur more than once, taken out of every document."""
    return _without_repeats(substring_dedup(table(spark, sf_dir, "documents")))


@query(
    "op11_source_mixing",
    f"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM d GROUP BY source),
c AS (SELECT *, {list(WEIGHTS)}[r % {len(WEIGHTS)} + 1]::DOUBLE AS w, {MAX_EPOCHS} * source_size AS cap FROM s),
b AS (SELECT *, cap / w AS ratio FROM c),
p AS (SELECT *, sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER o, 0)::DOUBLE AS rest, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS share
  FROM b WINDOW o AS (ORDER BY ratio, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT rest, share FROM p WHERE ratio * share > rest ORDER BY ratio, r LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN l.rest IS NULL OR ratio * l.share <= l.rest THEN cap::DOUBLE ELSE w * l.rest / l.share END AS target FROM b LEFT JOIN l ON true),
e AS (SELECT *, floor(target + 0.5)::BIGINT AS budget, CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS epochs FROM t),
k AS (SELECT doc_id, size, source_size, target, epochs, budget - epochs * source_size AS left_over,
  coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY substr(md5(concat_ws(':', '0', CAST(doc_id AS VARCHAR))), 1, 16), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, left_over - before)))::BIGINT AS taken FROM k""",
)
def op11_source_mixing(spark, sf_dir):
    """Words that a mix of all sources, at weights 1, 2, 3 in turn and at most three epochs, takes of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix_sources(docs, carry=["doc_id"])


@query(
    "op12_collocations",
    f"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({LOWER_SQL}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
x AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (SELECT lang, unnest([ws[i:i + 0], ws[i:i + 1], ws[i:i + 2]]) AS ph, unnest([1, 2, 3]) AS m, i, len(ws) AS k FROM x),
f AS (SELECT lang, ph, m, count(*) AS a FROM g WHERE i + m - 1 <= k GROUP BY ALL),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT c.lang, c.ph, c.m, c.a, l.a AS l, r.a AS r, l.m AS cut, 1000000 * c.a::HUGEINT * c.a // (l.a::HUGEINT * r.a) AS s FROM f c
  JOIN f l ON l.lang = c.lang AND l.m < c.m AND l.ph = c.ph[1:l.m] JOIN f r ON r.lang = c.lang AND r.m = c.m - l.m AND r.ph = c.ph[l.m + 1:] WHERE c.m > 1 AND c.a >= {MIN_COUNT}),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY s, cut) = 1),
h AS (SELECT lang, ph, max(a) AS most FROM (SELECT lang, ph[1:2] AS ph, a FROM b WHERE m = 3 UNION ALL SELECT lang, ph[2:3], a FROM b WHERE m = 3) GROUP BY ALL),
k AS (SELECT b.*, array_to_string(b.ph, ' ') AS phrase FROM b LEFT JOIN h ON h.lang = b.lang AND h.ph = b.ph WHERE most IS NULL OR 100 * most < {COVER} * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY s DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, s::BIGINT AS score
FROM k JOIN n USING (lang) QUALIFY rank <= {TOP}""",
)
def op12_collocations(spark, sf_dir):
    """The best phrases of two and three words of every language."""
    return mine_collocations(table(spark, sf_dir, "documents").select("text", "lang"))


@query(
    "op13_hard_negatives",
    """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10""",
)
def op13_hard_negatives(spark, sf_dir):
    """For every hundredth vector and its five positives, the ten hardest negatives below 90 % of the positive's score."""
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(vectors.select("vec_id", "embedding", label.alias("label")), F.col("vec_id") % 100 == 0)
