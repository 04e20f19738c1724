"""One query for each operator over its whole table, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trivane.llm import chat, decontaminate, fuzzy_lines, html_text, jaccard, line_hash, pieces, ppm, prefix_trie, quality_gbt, suffix, vector_codes, weak_rules
from trivane.llm.common import materialise


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "</s>[INST] ok [/INST]"
    rows = _read(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast(rows.schema["conv_id"].dataType).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(own).alias("text"))
    records = chat.turns_from_rows(rows.unionByName(extra), "conv_id", "turn", "role", "text")
    out = chat.format_chats(chat.to_turns(records, ["turns"]).drop("fingerprint")).select("conv_id", "layout", "segments", "formatted")
    back = out.select("conv_id", "layout", F.length("formatted").cast("long").alias("formatted_chars"), chat.parse_chats(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss"))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gbt.quality_scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_items(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_text.extract_text(_read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_hash.without_repeats(_read(spark, sf_dir, "documents").select("doc_id", "text"), unit="sentence", min_words=10)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", F.size("spans").cast("long").alias("n_spans"), removed.alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = fuzzy_lines.duplicate_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return lines.select(F.col("doc").alias("doc_id"), "line", F.concat(*[F.lpad(F.hex(F.col("group")[c]), 16, "0") for c in ("d1", "d2")]).alias("group_id"), "keep")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    vocabulary = pieces.Vocabulary.load(pieces.DEFAULT_MODEL)
    ids = pieces.encode(docs.withColumn("sha", F.sha2(F.coalesce("text", F.lit("")), 256)), vocabulary, carry=["doc_id", "sha"])
    ids = ids.withColumns({"n_tokens": F.size("ids").cast("long"), "ids_sha256": F.sha2(F.array_join("ids", " "), 256)})
    both = pieces.decode(ids, vocabulary, carry=["doc_id", "sha", "n_tokens", "ids_sha256"])
    both = both.withColumn("decoded_sha256", F.sha2("decoded", 256))
    return both.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", (F.col("decoded_sha256") == F.col("sha")).alias("round_trip"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix.without_repeated_strings(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    out = weak_rules.quality_rules(docs, carry=["doc_id"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return ppm.languages(docs, ppm.learn(docs))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.shared_prefix_trie(_read(spark, sf_dir, "conversations"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vector_codes.product_codes(_read(spark, sf_dir, "embeddings"))
    out = vector_codes.with_label_errors(materialise(codes, "codes"))
    return out.select("vec_id", "code", "error", "label_error", F.lit(vector_codes.codebooks_digest(books)).alias("codebooks_sha256"))


OP1_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, lower(coalesce(role, '')) AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), named AS (
  SELECT conv_id, turn, text, CASE WHEN role IN ('human', 'prompter') THEN 'user' WHEN role IN ('gpt', 'bot', 'model', 'chatgpt') THEN 'assistant' ELSE role END AS role FROM rows
), sized AS (
  SELECT *, length(regexp_replace(replace(text, '\', '\\'), '(<)(/?[sn]>)|(\[)(/?INST\])', '\1\3\\\2\4', 'g')) AS escaped,
    length(regexp_replace(replace(role, '\', '\\'), '(<)(/?[sn]>)|(\[)(/?INST\])', '\1\3\\\2\4', 'g')) + 2 * (length(role) - length(replace(role, chr(10), ''))) AS role_len
  FROM named
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(3 + 4 + 1 + role_len + escaped + CASE WHEN role = 'assistant' THEN 0 ELSE 7 + 7 END) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


OP6_SQL = r"""
WITH parts AS (
  SELECT doc_id, string_split(regexp_replace(replace(coalesce(text, ''), chr(10), chr(1114109) || chr(10) || chr(1114109)), '([.!?][ \t]+)', '\1' || chr(1114109), 'g'), chr(1114109)) AS u FROM documents
), units AS (
  SELECT doc_id, unnest(u) AS part, generate_subscripts(u, 1) AS i FROM parts
), formed AS (
  SELECT *, lower(trim(regexp_replace(part, '[ \t\r\x0b\x0c\n]+', ' ', 'g'), ' ')) AS form FROM units
), ranked AS (
  SELECT *, length(form) - length(replace(form, ' ', '')) + 1 >= 10 AS counts FROM formed
), dropped AS (
  SELECT doc_id, i, part, counts AND row_number() OVER (PARTITION BY counts, CASE WHEN counts THEN form ELSE doc_id || ' ' || i END ORDER BY doc_id, i) > 1 AS gone FROM ranked
)
SELECT doc_id, count(*) FILTER (gone) AS n_spans, CAST(coalesce(sum(length(part)) FILTER (gone), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(string_agg(part, '' ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM dropped GROUP BY doc_id
"""


def _rules_sql() -> str:
    """Features, votes and every round of the estimation as one chain of common table expressions."""
    r = weak_rules
    names = [x.name for x in r.RULES]
    votes = ", ".join(f"CASE WHEN ({x.good}) AND NOT ({x.bad}) THEN 1 WHEN ({x.bad}) AND NOT ({x.good}) THEN -1 ELSE 0 END AS v_{x.name}" for x in r.RULES)

    def posterior(p: str) -> str:
        side = lambda y: " + ".join([f"ln({p}.prior)" if y else f"ln(1 - {p}.prior)", *[f"CASE WHEN v_{k} = 1 THEN ln(1 - {p}.{k}_{y}) WHEN v_{k} = -1 THEN ln({p}.{k}_{y}) ELSE 0 END" for k in names]])
        return f"1 / (1 + exp(({side(0)}) - ({side(1)})))"

    ctes = [
        r"""words AS (SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
          list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents)""",
        "wins AS (SELECT row_number() OVER () AS id, doc_id, text, w, l FROM words)",
        "grams AS (SELECT id, p, w[p] || chr(10) || w[p + 1] || chr(10) || w[p + 2] AS g FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS p FROM wins))",
        "again AS (SELECT id, p FROM grams QUALIFY count(*) OVER (PARTITION BY id, g) >= 2)",
        "covered AS (SELECT id, count(DISTINCT p + k) AS n FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY id)",
        r"""f AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
          CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines,
          CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
          length(text) - length(regexp_replace(text, '\p{Lu}', '', 'g')) AS n_upper, length(text) - length(replace(text, '!', '')) AS n_bang,
          length(regexp_replace(text, '\P{L}', '', 'g')) AS n_letters, len(list_filter(w, lambda x: regexp_matches(x, '[#*$%&|<>]'))) AS n_marked
          FROM wins LEFT JOIN covered USING (id))""",
        f"v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {votes} FROM f)",
        f"pat AS (SELECT {', '.join('v_' + k for k in names)}, count(*) AS n FROM v GROUP BY ALL)",
        f"p0 AS (SELECT CAST({r.PRIOR} AS DOUBLE) AS prior, " + ", ".join(f"CAST({r.START[y]} AS DOUBLE) AS {k}_{y}" for k in names for y in (1, 0)) + ")",
    ]
    for i in range(r.ROUNDS):
        ctes.append(f"g{i} AS MATERIALIZED (SELECT pat.*, {posterior(f'p{i}')} AS g1, 1 - {posterior(f'p{i}')} AS g0 FROM pat, p{i})")
        cols = [f"(sum(n * g1) + {r.WEIGHT} * sum(n) * {r.PRIOR}) / (sum(n) + {r.WEIGHT} * sum(n)) AS prior"]
        for k in names:
            for y in (1, 0):
                e = f"(sum(CASE WHEN v_{k} = -1 THEN n ELSE 0 END * g{y}) + {r.WEIGHT} * sum(n) * {r.START[y]}) / (sum(CASE WHEN v_{k} <> 0 THEN n ELSE 0 END * g{y}) + {r.WEIGHT} * sum(n))"
                cols.append(f"{e} AS {k}_{y}")
        ctes.append(f"p{i + 1} AS MATERIALIZED (SELECT {', '.join(cols)} FROM g{i})")
    last = f"p{r.ROUNDS}"
    return f"WITH {', '.join(ctes)} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {posterior(last)} >= 0.5 AS kept FROM v, {last}"


#: CRC-32 of decimal digits by its definition, a byte at a time; turns with their number are md5 digests, a node is the list of its turns.
OP12_SQL = r"""
WITH RECURSIVE own AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS r
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, count(*) AS n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ascii(substr(conv_id::VARCHAR, i, 1))::BIGINT)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda c, bit: xor(c >> 1, 3988292384::BIGINT * (c & 1)))), 4294967295::BIGINT) % 9 AS h FROM own GROUP BY conv_id
), joined AS (
  SELECT c.conv_id, 0 AS later, o.r, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.conv_id - c.conv_id % 5 AND o.r <= c.h
  UNION ALL SELECT c.conv_id, 1, o.r, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.r > c.h
), turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY later, r) AS d, md5(length(role) || ':' || role || text) AS t, strlen(text) AS bytes FROM joined
), sized AS (
  SELECT conv_id, coalesce(n, 0) AS n, coalesce(path, []) AS path, coalesce(sizes, []) AS sizes FROM convs LEFT JOIN (SELECT conv_id, list(t ORDER BY d) AS path, list(bytes ORDER BY d) AS sizes FROM turns GROUP BY conv_id) p USING (conv_id)
), prefixes AS (
  SELECT conv_id, d, array_to_string(path[1:d], '') AS node, CASE WHEN d > 0 THEN array_to_string(path[1:d - 1], '') END AS parent, CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS bytes, d = len(path) AS ends
  FROM (SELECT *, unnest(range(len(path) + 1)) AS d FROM sized)
), nodes AS (
  SELECT node, min(conv_id) AS conv_id, min(d) AS depth, min(parent) AS parent, count(*) AS n_convs, min(bytes) AS bytes, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM prefixes GROUP BY node
), kids AS (
  SELECT parent AS node, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent
), known AS (
  SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (node)
), under AS (
  SELECT node AS above, node FROM nodes
  UNION ALL SELECT p.parent, u.node FROM under u JOIN nodes p ON p.node = u.above WHERE p.parent IS NOT NULL
), sums AS (
  SELECT above AS node, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * bytes) AS saved_tokens FROM under JOIN known USING (node) GROUP BY above
)
SELECT k.conv_id, k.depth, p.conv_id AS parent_conv_id, k.n_convs, k.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, k.ends_sha256
FROM known k JOIN sums s USING (node) LEFT JOIN nodes p ON p.node = k.parent
"""


def _codes_sql() -> str:
    """Every round as a common table expression; whole numbers of this size are exact in doubles."""
    p = vector_codes.CodeParams()
    assign = lambda i: (
        f"a{i} AS MATERIALIZED (SELECT id, part, min_by(e, (d, e)) AS e, min(d) AS d FROM (SELECT id, part, e, list_inner_product(x, x) + list_inner_product(c, c) - 2 * list_inner_product(x, c) AS d FROM v JOIN b{i} USING (part)) GROUP BY id, part)"
    )
    ctes = [
        f"""kept AS (SELECT row_number() OVER () AS id, vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * {p.scale})) AS x FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"v AS MATERIALIZED (SELECT id, part, x[part * len(x) // {p.parts} + 1:(part + 1) * len(x) // {p.parts}] AS x FROM kept, range({p.parts}) r(part))",
        f"s AS (SELECT id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept QUALIFY e < {p.entries})",
        "b0 AS MATERIALIZED (SELECT part, e, x AS c FROM v JOIN s USING (id))",
    ]
    for i in range(p.rounds):
        ctes.append(assign(i))
        ctes.append(f"m{i} AS (SELECT part, e, list(c ORDER BY j) AS c FROM (SELECT a.part, a.e, j, floor(sum(x[j]) / count(*)) AS c FROM v JOIN a{i} a USING (id, part), unnest(range(1, len(x) + 1)) u(j) GROUP BY ALL) GROUP BY part, e)")
        ctes.append(f"b{i + 1} AS MATERIALIZED (SELECT part, e, coalesce(m.c, b.c) AS c FROM b{i} b LEFT JOIN m{i} m USING (part, e))")
    ctes.append(assign(p.rounds))
    ctes.append(f"o AS (SELECT id, string_agg(printf('%02x', e), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{p.rounds} GROUP BY id)")
    ctes.append(f"book AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: x::BIGINT), ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM b{p.rounds})")
    return f"WITH {', '.join(ctes)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN o USING (id), book"


QUERIES = {
    "op1_chat_formatting": op1_chat_formatting,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_html_extraction": op4_html_extraction,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_line_dedup": op7_line_dedup,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_suffix_array_dedup": op9_suffix_array_dedup,
    "op10_quality_rules": op10_quality_rules,
    "op11_language_id": op11_language_id,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_vector_codes": op13_vector_codes,
}
ORACLES = {
    "op1_chat_formatting": OP1_SQL,
    "op6_substring_dedup": OP6_SQL,
    "op10_quality_rules": _rules_sql(),
    "op12_prefix_trie": OP12_SQL,
    "op13_vector_codes": _codes_sql(),
}
