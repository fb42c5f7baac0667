"""The registered queries of this subpackage, and the same question as SQL where SQL can ask it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import (ann, decontam, fixity, hpyp, language, neardup, packing, phrases, quality, tokenfiles, toxicity, urls,
                       whitening)


def _read(spark: SparkSession, sf_dir: str, *tables: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables]


def op1_hpyp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How probable is every document to a model of the others?"""
    return hpyp.score(*_read(spark, sf_dir, "documents"))


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which ten vectors are nearest to every hundredth one?"""
    return ann.nearest(*_read(spark, sf_dir, "embeddings"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How good is every document?"""
    return quality.quality(*_read(spark, sf_dir, "documents", "labels"))


def tokenizer_path() -> str:
    """The vocabulary file that packing counts tokens by."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which sequence of 2048 tokens does every piece of every document go to?"""
    return packing.pack(*_read(spark, sf_dir, "documents"), tokenizer_path())


def op5_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents hold passages of the benchmark?"""
    return decontam.contaminated(*_read(spark, sf_dir, "documents", "benchmark"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which language is every document in?"""
    return language.languages(*_read(spark, sf_dir, "documents"))


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Should every page's url be let in?"""
    return urls.judge(*_read(spark, sf_dir, "pages"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How toxic is every document?"""
    return toxicity.toxicity(*_read(spark, sf_dir, "documents", "labels"))


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents are near copies of which?"""
    setting = neardup.Settings(width=3, percent=85)
    return neardup.near_duplicates(*_read(spark, sf_dir, "documents"), setting).drop("node", "root")


def op10_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which WARC records of a damaged replica of the pages are not those of the first one?"""
    whole = fixity.records(*_read(spark, sf_dir, "pages"))
    return fixity.audit(whole, fixity.damaged(whole))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What are the leading whitened components of every vector?"""
    return whitening.whiten(*_read(spark, sf_dir, "embeddings"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which phrases hold together best in every language?"""
    return phrases.collocations(*_read(spark, sf_dir, "documents"))


def op13_tokenids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where do the token ids of every document stand in the files, and what are they?"""
    return tokenfiles.listed(spark, tokenfiles.write(*_read(spark, sf_dir, "documents"), tokenizer_path()))


QUERIES = {"op1_hpyp": op1_hpyp, "op2_ann": op2_ann, "op3_quality": op3_quality, "op4_packing": op4_packing, "op5_decontam": op5_decontam, "op6_language": op6_language, "op7_urls": op7_urls, "op8_toxicity": op8_toxicity, "op9_neardup": op9_neardup, "op10_fixity": op10_fixity, "op11_whitening": op11_whitening, "op12_phrases": op12_phrases, "op13_tokenids": op13_tokenids}
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

def _fits(rule: str) -> str:
    host, start = rule.split("/", 1)
    return f"((host = '{host}' OR suffix(host, '.{host}')) AND prefix(path, '/{start}'))"


def _by_rule(values: dict[str, str]) -> str:
    """CASE over the rules, longest first."""
    return "CASE " + " ".join(f"WHEN {_fits(r)} THEN '{values[r]}'" for r in sorted(values, key=lambda r: (-len(r), r))) + " END"


def _merge_level(source: str, made: str, d: int) -> str:
    """One level of merging in the tree of url templates, as CTEs."""
    up = ["host", *(f"t{k}" for k in range(1, d))]
    below = [f"t{k}" for k in range(d + 1, 5)]
    u, b = ", ".join(up), ", ".join(below)
    rest = ", ".join(c for c in ("t1", "t2", "t3", "t4") if c != f"t{d}")
    return f"""
        {made}_c AS (SELECT {u}, t{d}, {b}, sum(n) n, sum(labelled) l, sum(blocked) b FROM {source} GROUP BY ALL),
        {made}_b AS (SELECT {u}, t{d}, sum(n) bn, sum(l) bl, sum(b) bb FROM {made}_c GROUP BY ALL),
        {made}_p AS (SELECT {u}, {b}, sum(n) cn FROM {made}_c GROUP BY ALL),
        {made}_t AS (SELECT * FROM (SELECT {u}, sum(cn) pn, count(*) - 1 df FROM {made}_p GROUP BY ALL)
                     JOIN (SELECT {u}, sum(bl) pl, sum(bb) pb, count(*) branches FROM {made}_b GROUP BY ALL) USING ({u})),
        {made}_x AS (SELECT {u}, t{d}, sum(n::DOUBLE * n * pn / cn) x FROM {made}_c JOIN {made}_p USING ({u}, {b})
                     JOIN (SELECT {u}, pn FROM {made}_t) USING ({u}) GROUP BY ALL),
        {made}_n AS (SELECT {u}, t{d}, CASE WHEN branches > 1 AND bl > 0 AND x / bn - bn <= df + 3 * sqrt(2.0 * df) + 1e-6
                         AND abs(bb - bl * (pb / pl)) <= 2 * sqrt(bl * (pb / pl) * (1 - pb / pl)) + 0.5
                         THEN '~' ELSE t{d} END AS new
                     FROM {made}_b JOIN {made}_x USING ({u}, t{d}) JOIN {made}_t USING ({u})),
        {made} AS (SELECT host, s1, s2, s3, s4, n, labelled, blocked, {rest}, new AS t{d}
                   FROM {source} JOIN {made}_n USING ({u}, t{d})),"""


def _wild_level(source: str, made: str, d: int) -> str:
    up = ", ".join(["host", *(f"t{k}" for k in range(1, d))])
    return f"""
        {made}_e AS (SELECT {up}, s{d}, sum(n) en FROM {source} GROUP BY ALL),
        {made}_w AS (SELECT {up}, sum(en) whole, count(*) kinds FROM {made}_e GROUP BY ALL),
        {made} AS (SELECT {source}.*, CASE WHEN kinds >= 8 AND en < 0.05 * whole AND s{d} <> '' THEN '*' ELSE s{d} END AS t{d}
                   FROM {source} JOIN {made}_e USING ({up}, s{d}) JOIN {made}_w USING ({up})),"""


ORACLES: dict[str, str] = {
    "op10_fixity": """
        WITH r AS (SELECT page_id, floor(page_id / 4096)::BIGINT AS archive, (page_id * 7919) % 101 AS turn,
                   strlen('WARC/1.0' || 'WARC-Type: response' || 'WARC-Record-ID: <urn:page:' || page_id || '>'
                       || 'WARC-Target-URI: ' || coalesce(url, '') || 'Content-Length: ' || strlen(coalesce(html, ''))
                       || coalesce(html, '')) + 16 AS length FROM pages),
        o AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY archive ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM r)
        SELECT archive::VARCHAR AS archive, place::BIGINT AS "offset", length::BIGINT AS length,
               CASE WHEN turn = 11 THEN 'missing' ELSE 'changed' END AS kind
        FROM o WHERE turn IN (3, 7, 11)""",
    "op7_urls": f"""
        WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
        r AS (SELECT *, {_by_rule({r: r for _, r in urls.RULES})} AS rule, {_by_rule({r: v for v, r in urls.RULES})} AS ruled,
              list_filter(string_split(path, '/'), lambda x: x <> '') AS seg FROM p),
        o AS (SELECT *, CASE WHEN regexp_matches(coalesce(seg[1], ''), '[0-9]') THEN '*' ELSE coalesce(seg[1], '') END AS s1,
              CASE WHEN regexp_matches(coalesce(seg[2], ''), '[0-9]') THEN '*' ELSE coalesce(seg[2], '') END AS s2,
              CASE WHEN regexp_matches(coalesce(seg[3], ''), '[0-9]') THEN '*' ELSE coalesce(seg[3], '') END AS s3,
              CASE WHEN len(seg) > 3 THEN '**' ELSE '' END AS s4 FROM r),
        g0 AS (SELECT host, s1, s2, s3, s4, count(*) n, count(ruled) labelled, count(*) FILTER (ruled = 'block') blocked FROM o GROUP BY ALL),
        {_wild_level("g0", "g1", 1)}{_wild_level("g1", "g2", 2)}{_wild_level("g2", "g3", 3)}
        g4 AS (SELECT *, s4 AS t4 FROM g3),
        {_merge_level("g4", "m1", 1)}{_merge_level("m1", "m2", 2)}
        q AS (SELECT host, t1, t2, t3, t4, (sum(blocked) + 1) / (sum(labelled) + 2) >= 0.8 AS reject FROM m2 GROUP BY ALL),
        j AS (SELECT host, s1, s2, s3, s4, reject, host || CASE WHEN t1 <> '' THEN '/' || t1 ELSE '' END
              || CASE WHEN t2 <> '' THEN '/' || t2 ELSE '' END || CASE WHEN t3 <> '' THEN '/' || t3 ELSE '' END
              || CASE WHEN t4 <> '' THEN '/' || t4 ELSE '' END AS template FROM m2 JOIN q USING (host, t1, t2, t3, t4))
        SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN reject THEN 'block' ELSE 'allow' END) AS verdict, template
        FROM o JOIN j USING (host, s1, s2, s3, s4)""",
    "op12_phrases": r"""
        WITH p AS (SELECT lang, row_number() OVER () AS piece, regexp_extract_all(piece, '[^\x20\x09]+') AS w
              FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
        o AS MATERIALIZED (SELECT lang, piece, unnest(w) AS w1, unnest(range(len(w))) AS i FROM p),
        q AS (SELECT lang, w1, lead(w1, 1) OVER v AS w2, lead(w1, 2) OVER v AS w3, lead(w1, 3) OVER v AS w4 FROM o
              WINDOW v AS (PARTITION BY lang, piece ORDER BY i)),
        f AS MATERIALIZED (SELECT lang, 1 AS k, w1 AS phrase, count(*) AS f FROM q GROUP BY ALL
              UNION ALL SELECT lang, 2, w1 || ' ' || w2, count(*) FROM q WHERE w2 IS NOT NULL GROUP BY ALL
              UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*) FROM q WHERE w3 IS NOT NULL GROUP BY ALL
              UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4, count(*) FROM q WHERE w4 IS NOT NULL GROUP BY ALL),
        total AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
        c AS MATERIALIZED (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 30),
        cut AS (SELECT lang, phrase, a, j, array_to_string(w[1:j], ' ') AS lp, array_to_string(w[j + 1:], ' ') AS rp
                FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
        cl AS MATERIALIZED (SELECT cut.*, f AS l FROM cut JOIN f ON f.lang = cut.lang AND f.phrase = lp),
        s AS (SELECT cl.lang, cl.phrase, a, j, l, f AS r, ((2000000::HUGEINT * a) // (l + f))::BIGINT AS score
              FROM cl JOIN f ON f.lang = cl.lang AND f.phrase = rp),
        low AS (SELECT DISTINCT ON (lang, phrase) * FROM s ORDER BY lang, phrase, score, j),
        inside AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer
                   FROM (SELECT lang, w, a, m, unnest(range(1, k - m + 2)) AS i FROM c, range(2, 4) AS ms(m) WHERE m < k) GROUP BY ALL),
        kept AS (SELECT low.* FROM low LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000""",
    "op9_neardup": f"""
        WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ')
                  ELSE array_to_string(w[i:i + 2], ' ') END AS s
              FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM w WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id
                   GROUP BY ALL),
        link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
        reach AS (SELECT doc_id AS v, doc_id AS r FROM documents UNION SELECT v, b FROM reach JOIN link ON r = a),
        low AS (SELECT v AS doc_id, min(r) AS component_id FROM reach GROUP BY v)
        SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, component_id = doc_id AS kept
        FROM documents LEFT JOIN n USING (doc_id) JOIN low USING (doc_id)""",
}
