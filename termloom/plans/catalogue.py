"""The query catalogue over the synthetic tables, and equivalent DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import cli
from ..functions import sequences as seq
from ..operators import apriori_index, block_index, block_levels, closure, decode, dictionary, encode, suffix
from ..sources import store
from ..sources.lines import lines_from_files, lines_from_table
from ..types import METHODS, NGramType, Params
from .api import encode_in_blocks, ngram_statistics

SUPPORT, LENGTH = 5, 5
Query = Callable[[SparkSession, str], DataFrame]


def _lines(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    ids = {"documents": "doc_id", "conversations": ["conv_id", "turn"], "benchmark": "item_id", "pages": "page_id"}[table]
    return lines_from_table(spark.read.parquet(f"{sf_dir}/{table}.parquet"), ids, "html" if table == "pages" else "text")


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.tokens(_lines(spark, sf_dir))


def _dictionary(words: DataFrame) -> DataFrame:
    return dictionary.build_dictionary(dictionary.word_counts(words))


def tokenize_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = dictionary.tokenize(F.col("line"))
    return _lines(spark, sf_dir).select("doc_id", "line_no", F.size(words).alias("n_tokens"))


def tokenize_lines_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = dictionary.tokenize(F.col("line"), "reference")
    return _lines(spark, sf_dir).select("doc_id", "line_no", F.size(words).alias("n_tokens"))


def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.word_counts(_words(spark, sf_dir))


def dictionary_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dictionary(_words(spark, sf_dir))


def encoded_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _words(spark, sf_dir)
    return encode.encode(words, _dictionary(words))


def encoded_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = encode.collect_lines(encoded_tokens(spark, sf_dir))
    return lines.select("doc_id", "line_no", seq.as_text(F.col("tids")).alias("tids"))


def frequent_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.frequent_terms(dictionary_ids(spark, sf_dir), SUPPORT)


def _frequent(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    words = _words(spark, sf_dir)
    found = dictionary.frequent_terms(_dictionary(words), SUPPORT)
    return encode.frequent_words(words, found, SUPPORT), found


def frequent_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.frequent_runs(_frequent(spark, sf_dir)[0]).select("doc_id", "line_no", "start", "len")


def suffixes_sigma5(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = store.Levels(spark, "suffixes")
    encoded, _ = encode_in_blocks(_lines(spark, sf_dir), SUPPORT, levels)
    made = block_levels.mine_levels(encoded, SUPPORT, LENGTH, NGramType.ALL, levels, suffixes=True)
    return block_levels.put_out(encoded, made, NGramType.ALL, levels).select(F.col("ngram").alias("suffix"), F.col("support").alias("count"))


def _ngrams(spark: SparkSession, sf_dir: str, table: str, kind: NGramType, method: str, support: int = SUPPORT, length: int = LENGTH, empty_token: str = "drop") -> DataFrame:
    return ngram_statistics(_lines(spark, sf_dir, table), support, length, kind, method, empty_token)


def _one_filter(spark: SparkSession, sf_dir: str, keep: Callable, kind: NGramType) -> DataFrame:
    frequent, words = _frequent(spark, sf_dir)
    return decode.decode(keep(suffix.suffix_ngrams(frequent, SUPPORT, LENGTH), kind), words)


def postings_k2(spark: SparkSession, sf_dir: str) -> DataFrame:
    frequent, words = _frequent(spark, sf_dir)
    index, counts = apriori_index.keep_frequent(apriori_index.positions(frequent, 2), SUPPORT)
    lists = apriori_index.posting_lists(index).select("gram", F.explode("postings").alias("p"))
    named = decode.decode(counts, words, keep_gram=True)
    return lists.join(named, "gram").select("ngram", "p.doc_id", "p.line_no", seq.as_text(F.col("p.offsets")).alias("offsets"))


def index_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    frequent, words = _frequent(spark, sf_dir)
    lists = apriori_index.posting_lists(apriori_index.positions(frequent, 2)).where(F.col("support") >= SUPPORT)
    totals = F.aggregate("postings", F.lit(0).cast("long"), lambda a, p: a + seq.term_frequency(p["offsets"]))
    return decode.decode(lists.select("gram", totals.alias("support")), words)


def scalar_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of each line's words against all but the first, all but the last, and in reverse."""
    a = dictionary.tokenize(F.col("line"))
    rows = _lines(spark, sf_dir).select("doc_id", "line_no", a.alias("a"), F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))).alias("p"), F.slice(a, F.lit(2), F.size(a)).alias("b"))
    return rows.select(
        "doc_id",
        "line_no",
        seq.lcp(F.col("a"), F.col("b")).alias("lcp_shifted"),
        seq.lcp(F.col("a"), F.col("p")).alias("lcp_prefix"),
        seq.is_prefix(F.col("p"), F.col("a")).alias("p_is_prefix"),
        seq.is_prefix(F.col("b"), F.col("a")).alias("b_is_prefix"),
        seq.is_suffix(F.col("b"), F.col("a")).alias("tail_is_suffix"),
        seq.is_suffix(F.col("p"), F.col("a")).alias("p_is_suffix"),
        F.array_join(F.reverse("a"), " ").alias("reversed"),
    )


def windows_of_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line's words without the first and the last one."""
    words = dictionary.tokenize(F.col("line"))
    words = seq.window(words, 1, F.size(words) - 1)
    return _lines(spark, sf_dir).select("doc_id", "line_no", F.array_join(words, " ").alias("words"))


def text_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of text files, which are written from the table first."""
    at = f"{store.Levels(spark, 'text-scan').path}/lines"
    _lines(spark, sf_dir).select("line").write.text(at)
    return lines_from_files(spark, at).groupBy("line").agg(F.count(F.lit(1)).alias("count"), F.count(F.when(F.col("line_no") < 0, 1)).alias("misplaced"))


def stored_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = f"{store.Levels(spark, 'stored-dictionary').path}/dic"
    store.write_dictionary(dictionary_ids(spark, sf_dir), at)
    return store.read_dictionary(spark, at)


def stored_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = f"{store.Levels(spark, 'stored-lines').path}/seq"
    store.write_encoded(encode.collect_lines(encoded_tokens(spark, sf_dir)), at)
    return store.read_encoded(spark, at).select("doc_id", "line_no", seq.as_text(F.col("tids")).alias("tids"))


def stored_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N-grams as term ids, stored by length, then decoded."""
    at = f"{store.Levels(spark, 'stored-ngrams').path}/result"
    frequent, words = _frequent(spark, sf_dir)
    grams = suffix.suffix_ngrams(frequent, SUPPORT, LENGTH)
    store.write_ngrams(grams.select("gram", F.size("gram").alias("n"), "support"), at, by_length=True)
    return decode.decode(store.read_ngrams(spark, at), words)


def stored_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of frequent pairs, stored as posting lists."""
    levels = store.Levels(spark, "stored-index")
    at = f"{levels.path}/index"
    placed, words = block_index.place_in_blocks(_lines(spark, sf_dir), SUPPORT, levels)
    store.write_index(block_index.pair_lists(placed, words, SUPPORT), at)
    levels.drop("placed")
    store.release(spark)
    return block_index.decoded_positions(store.read_index(spark, at), words)


def stored_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = f"{store.Levels(spark, 'stored-text').path}/text"
    store.write_text(_ngrams(spark, sf_dir, "documents", NGramType.ALL, "suffix"), at)
    return store.read_text(spark, at)


def overwrite_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two results written to one place, n-grams keep the later one and text the earlier one."""
    at = store.Levels(spark, "overwrite-rules").path
    lines, refused = _lines(spark, sf_dir, "benchmark"), 0
    for support in (3, 2):
        grams = ngram_statistics(lines, support, 3, decoded=False)
        store.write_ngrams(grams, f"{at}/result")
        try:
            store.write_text(ngram_statistics(lines, support, 3), f"{at}/text")
        except AnalysisException:
            refused += 1
    lengths = store.read_ngrams(spark, f"{at}/result").groupBy("n", "support").agg(F.count(F.lit(1)).alias("grams"))
    text = store.read_text(spark, f"{at}/text").groupBy((F.size(F.split("ngram", " "))).alias("n"), "support").agg(F.count(F.lit(1)).alias("grams"))
    return lengths.withColumn("sink", F.lit("ngrams")).unionByName(text.withColumn("sink", F.lit("text"))).withColumn("refused", F.lit(refused))


def dropped_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intermediate tables: one dropped, one kept and read back."""
    levels = store.Levels(spark, "dropped-tables")
    counts = dictionary.word_counts(_words(spark, sf_dir))
    kept = levels.keep(counts, "kept")
    levels.keep(counts, "dropped")
    levels.drop("dropped")
    totals = kept.agg(F.count(F.lit(1)).alias("words"), F.sum("count").alias("tokens"))
    there = F.array(*[F.struct(F.lit(t).alias("table"), F.lit(levels.holds(t)).alias("there")) for t in ("kept", "dropped")])
    return totals.select(F.inline(there), "words", "tokens")


def convert_compute_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three commands, one after the other, on text files."""
    at = store.Levels(spark, "commands").path
    _lines(spark, sf_dir).select("line").write.option("compression", "gzip").text(f"{at}/in")
    cli.convert(spark, f"{at}/in", f"{at}/collection")
    cli.compute(spark, f"{at}/collection", f"{at}/result", Params(10, LENGTH, NGramType.CLOSED, "suffix"))
    cli.decode_result(spark, f"{at}/result", f"{at}/collection", f"{at}/statistics")
    return store.read_text(spark, f"{at}/statistics")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed n-grams by the suffix method."""
    return _ngrams(spark, sf_dir, "documents", NGramType.CLOSED, "suffix")


def queries() -> dict[str, Query]:
    plain = (
        tokenize_lines, tokenize_lines_reference, word_counts, dictionary_ids, encoded_tokens, encoded_lines, frequent_terms, frequent_runs,
        suffixes_sigma5, postings_k2, index_support, scalar_sequences, windows_of_lines, text_scan, stored_dictionary,
        stored_lines, stored_ngrams, stored_index, stored_text, overwrite_rules, dropped_tables, convert_compute_decode,
    )
    found: dict[str, Query] = {f.__name__: f for f in plain}
    for kind in NGramType:
        for method in METHODS:
            found[f"ngrams_{kind.name.lower()}_{method}"] = partial(_ngrams, table="documents", kind=kind, method=method)
    for kind in (NGramType.CLOSED, NGramType.MAXIMAL):
        found[f"ngrams_prefix_{kind.name.lower()}"] = partial(_one_filter, keep=closure.prefix_filter, kind=kind)
        found[f"ngrams_suffix_{kind.name.lower()}"] = partial(_one_filter, keep=closure.suffix_filter, kind=kind)
    found["ngrams_unlimited_small"] = partial(_ngrams, table="benchmark", kind=NGramType.ALL, method="suffix", support=10, length=0)
    found["ngrams_unlimited"] = partial(_ngrams, table="documents", kind=NGramType.ALL, method="suffix", length=0)
    found["ngrams_sigma10"] = partial(_ngrams, table="documents", kind=NGramType.ALL, method="suffix", length=10)
    found["ngrams_sigma10_apriori_index"] = partial(_ngrams, table="documents", kind=NGramType.ALL, method="apriori_index", length=10)
    for kind in (NGramType.CLOSED, NGramType.MAXIMAL):
        found[f"ngrams_sigma10_{kind.name.lower()}"] = partial(_ngrams, table="documents", kind=kind, method="suffix", length=10)
        found[f"ngrams_unlimited_{kind.name.lower()}"] = partial(_ngrams, table="documents", kind=kind, method="suffix", length=0)
        found[f"ngrams_unlimited_small_{kind.name.lower()}"] = partial(_ngrams, table="benchmark", kind=kind, method="suffix", support=10, length=0)
    found["ngrams_sigma40"] = partial(_ngrams, table="benchmark", kind=NGramType.ALL, method="suffix", support=2, length=40)
    found["ngrams_reference_tokens"] = partial(_ngrams, table="documents", kind=NGramType.ALL, method="suffix", empty_token="reference")
    found["conversation_ngrams"] = partial(_ngrams, table="conversations", kind=NGramType.ALL, method="suffix")
    found["benchmark_ngrams"] = partial(_ngrams, table="benchmark", kind=NGramType.CLOSED, method="naive", support=2)
    found["pages_ngrams"] = partial(_ngrams, table="pages", kind=NGramType.MAXIMAL, method="apriori_scan", support=10)
    return found


_EMPTY = "lambda w: w <> ''"


def _base(table: str = "documents", ids: str = "doc_id", text: str = "text", reference: bool = False) -> str:
    """CTEs ``lines`` and ``toks`` (words of each line; ``reference``: with the empty word that a plain split leaves)."""
    s = "regexp_replace(lower(line), '[^a-z0-9'']', ' ', 'g')"
    words = f"list_filter(string_split({s}, ' '), {_EMPTY})"
    if reference:
        words = f"CASE WHEN line = '' THEN [''] WHEN trim({s}) = '' THEN [] WHEN {s} LIKE ' %' THEN list_concat([''], {words}) ELSE {words} END"
    return f"""
        texts AS (SELECT {ids} AS doc_id, regexp_replace({text}, '(\\r\\n|\\r|\\n)$', '') AS t FROM {table} WHERE {text} <> ''),
        split AS (SELECT doc_id, regexp_split_to_array(t, '\\r\\n|\\r|\\n') AS l FROM texts),
        lines AS (SELECT doc_id, unnest(l) AS line, CAST(unnest(range(len(l))) AS INT) AS line_no FROM split),
        toks AS (
            SELECT doc_id, line_no, {words} AS w FROM lines
        )"""


_WORDS = "words AS (SELECT doc_id, line_no, unnest(w) AS word, CAST(unnest(range(len(w))) AS INT) AS pos FROM toks)"
_DICT = """dict AS (
            SELECT word, CAST(row_number() OVER (ORDER BY count(*) DESC, word) AS INT) AS tid, count(*) AS count FROM words GROUP BY word
        )"""


def _grams(length: int, support: int) -> str:
    """CTE ``grams``: words of each n-gram with enough support."""
    return f"""
        spans AS (SELECT w, unnest(range(1, len(w) + 1)) AS i FROM toks),
        cut AS (SELECT w, i, unnest(range(0, least({length}, len(w) - i + 1))) AS m FROM spans),
        grams AS (SELECT w[i:i + m] AS g, count(*) AS support FROM cut GROUP BY 1 HAVING count(*) >= {support})"""


def _unlimited_grams(support: int) -> str:
    """The same of any length, without all subsequences of long lines: a position stays while its n-gram has enough support, and is known by the first one with the same n-gram."""
    same = "o.same, k.tid"
    return f"""{_WORDS}, {_DICT},
        keyed AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY doc_id, line_no, pos) AS id, dense_rank() OVER (ORDER BY doc_id, line_no) AS line, doc_id, line_no, pos, tid
            FROM words JOIN dict USING (word)
        ),
        places AS (
            SELECT id, line, 1 AS n, min(id) OVER (PARTITION BY tid) AS same FROM keyed QUALIFY count(*) OVER (PARTITION BY tid) >= {support}
            UNION ALL
            SELECT o.id, o.line, o.n + 1, min(o.id) OVER (PARTITION BY {same}) FROM places o JOIN keyed k ON k.id = o.id + o.n AND k.line = o.line
            QUALIFY count(*) OVER (PARTITION BY {same}) >= {support}
        ),
        found AS (SELECT same AS id, n, count(*) AS support FROM places GROUP BY ALL),
        grams AS (SELECT w[pos + 1:pos + n] AS g, support FROM found JOIN keyed USING (id) JOIN toks USING (doc_id, line_no))"""


_OUT = "array_to_string(g, ' ') AS ngram, CAST(len(g) AS INT) AS n, support"
_LONGER = {
    "prefix": "SELECT g[1:len(g) - 1] AS g, support FROM grams WHERE len(g) > 1",
    "suffix": "SELECT g[2:len(g)] AS g, support FROM grams WHERE len(g) > 1",
}
_LONGER["both"] = f"{_LONGER['prefix']} UNION ALL {_LONGER['suffix']}"


def _ngram_sql(kind: NGramType, side: str = "both", base: str | None = None, length: int = LENGTH, support: int = SUPPORT) -> str:
    with_ = f"WITH RECURSIVE {base or _base()}, {_grams(length, support) if length else _unlimited_grams(support)}"
    if kind is NGramType.ALL:
        return f"{with_} SELECT {_OUT} FROM grams"
    equal = "AND l.support = k.support" if kind is NGramType.CLOSED else ""
    return f"{with_}, longer AS ({_LONGER[side]}) SELECT {_OUT} FROM grams k WHERE NOT EXISTS (SELECT 1 FROM longer l WHERE l.g = k.g {equal})"


def oracle_sql() -> dict[str, str]:
    base, freq = _base(), f"freq AS (SELECT * FROM dict WHERE count >= {SUPPORT})"
    kept = "kept AS (SELECT w.* FROM words w JOIN freq USING (word))"
    islands = "islands AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, line_no ORDER BY pos) AS run FROM kept)"
    pairs = f"""pairs AS (
            SELECT a.doc_id, a.line_no, a.pos, a.word || ' ' || b.word AS ngram
            FROM words a JOIN words b ON a.doc_id = b.doc_id AND a.line_no = b.line_no AND b.pos = a.pos + 1
        ), often AS (SELECT ngram, count(*) AS support FROM pairs GROUP BY ngram HAVING count(*) >= {SUPPORT})"""
    out = {
        "tokenize_lines": f"WITH {base} SELECT doc_id, line_no, CAST(len(w) AS INT) AS n_tokens FROM toks",
        "tokenize_lines_reference": f"""WITH {base},
            s AS (SELECT doc_id, line_no, regexp_replace(lower(line), '[^a-z0-9'']', ' ', 'g') AS s FROM lines)
            SELECT doc_id, line_no, CAST(CASE WHEN s = '' THEN 1 WHEN trim(s) = '' THEN 0
                   ELSE len(list_filter(string_split(s, ' '), {_EMPTY})) + CAST(s LIKE ' %' AS INT) END AS INT) AS n_tokens FROM s""",
        "word_counts": f"WITH {base}, {_WORDS} SELECT word, count(*) AS count FROM words GROUP BY word",
        "dictionary_ids": f"WITH {base}, {_WORDS}, {_DICT} SELECT word, tid, count FROM dict",
        "encoded_tokens": f"WITH {base}, {_WORDS}, {_DICT} SELECT doc_id, line_no, pos, tid FROM words JOIN dict USING (word)",
        "encoded_lines": f"""WITH {base}, {_WORDS}, {_DICT}
            SELECT doc_id, line_no, '[' || string_agg(CAST(tid AS VARCHAR), ', ' ORDER BY pos) || ']' AS tids
            FROM words JOIN dict USING (word) GROUP BY doc_id, line_no""",
        "frequent_terms": f"WITH {base}, {_WORDS}, {_DICT}, {freq} SELECT word, tid, count FROM freq",
        "frequent_runs": f"""WITH {base}, {_WORDS}, {_DICT}, {freq}, {kept}, {islands}
            SELECT doc_id, line_no, min(pos) AS start, CAST(count(*) AS INT) AS len FROM islands GROUP BY doc_id, line_no, run""",
        "suffixes_sigma5": f"""WITH {base}, {_WORDS}, {_DICT}, {freq}, {kept}, {islands},
            ahead AS (
                SELECT string_agg(word, ' ') OVER (PARTITION BY doc_id, line_no, run ORDER BY pos ROWS BETWEEN CURRENT ROW AND {LENGTH - 1} FOLLOWING)
                       AS suffix FROM islands
            ) SELECT suffix, count(*) AS count FROM ahead GROUP BY suffix""",
        "postings_k2": f"""WITH {base}, {_WORDS}, {pairs}
            SELECT ngram, doc_id, line_no, '[' || string_agg(CAST(pos AS VARCHAR), ', ' ORDER BY pos) || ']' AS offsets
            FROM pairs JOIN often USING (ngram) GROUP BY ngram, doc_id, line_no""",
        "index_support": f"WITH {base}, {_WORDS}, {pairs} SELECT ngram, CAST(2 AS INT) AS n, support FROM often",
        "scalar_sequences": f"""WITH {base}, v AS (SELECT doc_id, line_no, w AS a, w[1:len(w) - 1] AS p, w[2:len(w)] AS b FROM toks)
            SELECT doc_id, line_no,
                   CAST(coalesce(list_min(list_filter(range(1, len(b) + 1), lambda i: a[i] <> b[i])) - 1, len(b)) AS INT) AS lcp_shifted,
                   CAST(len(p) AS INT) AS lcp_prefix, a[1:len(p)] = p AS p_is_prefix, a[1:len(b)] = b AS b_is_prefix,
                   a[len(a) - len(b) + 1:len(a)] = b AS tail_is_suffix, a[len(a) - len(p) + 1:len(a)] = p AS p_is_suffix,
                   array_to_string(list_reverse(a), ' ') AS reversed FROM v""",
    }
    all_grams, small = _ngram_sql(NGramType.ALL), _base("benchmark", "item_id")
    lengths = "SELECT CAST(len(g) AS INT) AS n, support, count(*) AS grams, '{0}' AS sink, CAST(1 AS INT) AS refused FROM grams WHERE support >= {1} GROUP BY 1, 2"
    out |= {
        "windows_of_lines": f"WITH {base} SELECT doc_id, line_no, array_to_string(w[2:len(w) - 1], ' ') AS words FROM toks",
        "text_scan": f"WITH {base} SELECT line, count(*) AS count, CAST(0 AS BIGINT) AS misplaced FROM lines GROUP BY line",
        "stored_dictionary": out["dictionary_ids"],
        "stored_lines": out["encoded_lines"],
        "stored_ngrams": all_grams,
        "stored_index": f"WITH {base}, {_WORDS}, {pairs} SELECT ngram, doc_id, line_no, pos FROM pairs JOIN often USING (ngram)",
        "stored_text": f"SELECT ngram, support FROM ({all_grams})",
        "overwrite_rules": f"WITH {small}, {_grams(3, 2)} {lengths.format('ngrams', 2)} UNION ALL {lengths.format('text', 3)}",
        "dropped_tables": f"""WITH {base}, {_WORDS}, totals AS (SELECT count(DISTINCT word) AS words, count(*) AS tokens FROM words)
            SELECT 'kept' AS "table", true AS there, words, tokens FROM totals UNION ALL SELECT 'dropped', false, words, tokens FROM totals""",
        "convert_compute_decode": f"SELECT ngram, support FROM ({_ngram_sql(NGramType.CLOSED, support=10)})",
        "ngrams_sigma10_apriori_index": _ngram_sql(NGramType.ALL, length=10),
        "ngrams_sigma40": _ngram_sql(NGramType.ALL, base=small, length=40, support=2),
        "ngrams_reference_tokens": _ngram_sql(NGramType.ALL, base=_base(reference=True)),
    }
    for kind in (NGramType.CLOSED, NGramType.MAXIMAL):
        out[f"ngrams_sigma10_{kind.name.lower()}"] = _ngram_sql(kind, length=10)
        out[f"ngrams_unlimited_{kind.name.lower()}"] = _ngram_sql(kind, length=0)
        out[f"ngrams_unlimited_small_{kind.name.lower()}"] = _ngram_sql(kind, base=small, length=10_000, support=10)
    for kind in NGramType:
        for method in METHODS:
            out[f"ngrams_{kind.name.lower()}_{method}"] = _ngram_sql(kind)
    for kind in (NGramType.CLOSED, NGramType.MAXIMAL):
        for side in ("prefix", "suffix"):
            out[f"ngrams_{side}_{kind.name.lower()}"] = _ngram_sql(kind, side)
    out["ngrams_unlimited"] = _ngram_sql(NGramType.ALL, length=0)
    # Without a limit on the length: no line of this table is longer than 10,000 words.
    out["ngrams_unlimited_small"] = _ngram_sql(NGramType.ALL, base=_base("benchmark", "item_id"), length=10_000, support=10)
    out["ngrams_sigma10"] = _ngram_sql(NGramType.ALL, length=10)
    out["conversation_ngrams"] = _ngram_sql(NGramType.ALL, base=_base("conversations", "{'conv_id': conv_id, 'turn': turn}"))
    out["benchmark_ngrams"] = _ngram_sql(NGramType.CLOSED, base=_base("benchmark", "item_id"), support=2)
    out["pages_ngrams"] = _ngram_sql(NGramType.MAXIMAL, base=_base("pages", "page_id", "html"), support=10)
    return out
