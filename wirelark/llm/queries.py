"""The registered queries of this package, with the SQL that checks those that SQL can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wirelark.llm import chat, decontaminate, langid, licenses, merkle, minhash, mixing, quality, simhash, tokencount, toxicity, warc, whitening
from wirelark.llm.shared import Scratch

QUERIES = {}
ORACLES = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _escaped_sql(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for c in chat.CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


@query(f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
    e AS (SELECT *, md5(role || chr(10) || text) AS tie, length({_escaped_sql('text')})
      + CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 11 WHEN 'system' THEN 11 ELSE 18 + length({_escaped_sql('role')}) END AS size FROM c)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, tie)) AS turns_sha256,
      coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, tie) FILTER (role = 'assistant'), '')) AS loss_sha256,
      (sum(size) + 7)::BIGINT AS formatted_chars FROM e GROUP BY conv_id""")
def op1_chat(spark, sf_dir):
    """All conversations and one that quotes control strings, formatted and read back."""
    import public_tokenizers
    template = chat.Template(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    quoted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                   F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(quoted)
    return chat.read_back(chat.assemble(chat.encode_turns(rows, template), template), template).drop("n_tokens")


@query()
def op2_tokens(spark, sf_dir):
    import public_tokenizers
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = tokencount.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


@query("""WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
    f AS (SELECT d, min(page_id) AS first_id FROM p WHERE n >= 100 GROUP BY d)
    SELECT page_id, n::BIGINT AS payload_bytes, p.d AS payload_digest,
      CASE WHEN n >= 100 AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN n >= 100 AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
    FROM p LEFT JOIN f ON p.d = f.d""")
def op3_warc(spark, sf_dir):
    """All pages to archives, read back and merged into capture histories."""
    pages = table(spark, sf_dir, "pages")
    scratch = Scratch(spark, "warc")
    warc.write_archives(pages, scratch.path("archives"))
    runs = scratch.table("runs", warc.read_runs(spark, scratch.path("archives")))
    merged = warc.histories(runs, pages.count())
    return merged.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def mixture_levels() -> list[mixing.Level]:
    """Domain, language, source. The sample tables have no domain: it is the source's number modulo 4."""
    number = F.coalesce(F.try_to_number(F.regexp_extract(F.coalesce("source", F.lit("")), "([0-9]{1,6})$", 1), F.lit("999999")), F.lit(0)).cast("long")
    return [mixing.Level("domain", number % 4, number % 4 + 1),
            mixing.Level("lang", F.col("lang"), F.when(F.col("lang") == "en", 3).otherwise(2)),
            mixing.Level("source", F.col("source"), number % 3 + 1)]


MIXTURE = dict(share=0.8, epochs=2, seed=20)


def _mixing_sql() -> str:
    """The same budgets and prefixes over whole tables."""
    steps, keys = [], ["k0", "k1", "k2"]
    for i in range(3):
        own, parent = ", ".join(keys[:i + 1]), ", ".join(keys[:i])
        over = f"PARTITION BY {parent} " if i else ""
        join = f"JOIN given{i - 1} USING ({parent})" if i else "CROSS JOIN total"
        steps.append(f"""node{i} AS (SELECT {own}, cap, w, budget FROM (SELECT {own}, sum(tokens) * 2 AS cap, max(w{i}) AS w
          FROM leaf GROUP BY {own}) {join}),
        step{i} AS (SELECT *, coalesce(sum(cap) OVER before, 0) * w + cap * sum(w) OVER onward <= budget * w AS is_full FROM node{i}
          WINDOW before AS ({over}ORDER BY cap::DOUBLE / w, {keys[i]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                 onward AS ({over}ORDER BY cap::DOUBLE / w, {keys[i]} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
        given{i} AS (SELECT {own}, CASE WHEN is_full THEN cap ELSE (budget - coalesce(sum(CASE WHEN is_full THEN cap END) OVER ({over}), 0)) * w
          // sum(CASE WHEN NOT is_full THEN w END) OVER ({over}) END AS budget FROM step{i})""")
    return f"""WITH numbered AS (SELECT *, coalesce(try_cast(regexp_extract(coalesce(source, ''), '([0-9]{{1,6}})$', 1) AS BIGINT), 0) AS number FROM documents),
        d AS (SELECT doc_id, lang, source, number % 4 AS domain, '=' || (number % 4)::VARCHAR AS k0, coalesce('=' || lang, '-') AS k1, coalesce('=' || source, '-') AS k2,
          number % 4 + 1 AS w0, CASE WHEN lang = 'en' THEN 3 ELSE 2 END AS w1, number % 3 + 1 AS w2, md5(coalesce(text, '')) AS tie,
          len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens FROM numbered),
        leaf AS (SELECT k0, k1, k2, sum(n_tokens) AS tokens, max(w0) AS w0, max(w1) AS w1, max(w2) AS w2 FROM d GROUP BY ALL),
        total AS (SELECT floor(sum(tokens) * 0.8::DOUBLE)::HUGEINT AS budget FROM leaf),
        {", ".join(steps)},
        plan AS (SELECT k0, k1, k2, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS whole, budget, tokens FROM leaf JOIN given2 USING (k0, k1, k2)),
        h AS (SELECT *, ('0x' || substr(md5('20/' || whole::VARCHAR || '/' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h,
          CASE WHEN whole < 2 THEN budget - whole * tokens ELSE -1 END AS rest FROM d JOIN plan USING (k0, k1, k2)),
        run AS (SELECT *, sum(n_tokens) OVER (PARTITION BY k0, k1, k2 ORDER BY h, doc_id, tie) AS upto FROM h)
        SELECT doc_id, domain::BIGINT AS domain, lang, source, n_tokens, unnest(range(0, (whole + (upto <= rest)::INT)::BIGINT)) AS epoch FROM run"""


@query(_mixing_sql())
def op4_mixture(spark, sf_dir):
    """All documents, mixed to the weights of mixture_levels()."""
    levels = mixture_levels()
    mixed = mixing.mix(table(spark, sf_dir, "documents"), levels, **MIXTURE)
    return mixed.select("doc_id", levels[0].value.alias("domain"), "lang", "source", "n_tokens", "epoch")


@query()
def op5_simhash(spark, sf_dir):
    found = simhash.groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex(simhash.FP), 16, "0")).alias("fingerprint"), "component_id")


_WORDS = "regexp_extract_all(lower_ascii, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM (SELECT doc_id, {_LOWER} AS lower_ascii FROM documents)),
    b AS (SELECT item_id, {_WORDS} AS w FROM (SELECT item_id, {_LOWER} AS lower_ascii FROM benchmark)),
    win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS phrase
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM b WHERE len(w) > 0)),
    size AS (SELECT DISTINCT n FROM win),
    place AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS phrase
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, size WHERE len(w) >= n)),
    hit AS (SELECT doc_id, item_id, k, n FROM place JOIN win USING (n, phrase)),
    word AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hit) GROUP BY 1),
    item AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hit) GROUP BY 1)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
      sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN word USING (doc_id) LEFT JOIN item USING (doc_id)""")
def op6_decontaminate(spark, sf_dir):
    phrases = decontaminate.load_phrases(table(spark, sf_dir, "benchmark"))
    return decontaminate.mark(table(spark, sf_dir, "documents").select("doc_id", "text"), phrases,
                              only=["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]).drop("text")


@query()
def op7_licenses(spark, sf_dir):
    found = licenses.find_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"), licenses.build())
    names = F.array_sort(F.array_distinct("findings.license"))
    return found.select("doc_id", F.size("findings").cast("long").alias("n_findings"), F.array_join(names, ",").alias("licenses"),
                        F.coalesce(F.array_max("findings.coverage"), F.lit(0.0)).alias("coverage"), "findings")


@query()
def op8_quality(spark, sf_dir):
    return quality.judge(table(spark, sf_dir, "documents")).drop("distance")


@query()
def op9_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~toxicity.held_out()))
    return toxicity.score(docs, net).select(
        "doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"), "n_windows")


TOXIC = 0.7


@query()
def op10_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(~langid.held_out()))
    return langid.predict(docs.drop("lang"), model).select(
        "doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "known_share", "n_ngrams")


def tampered() -> Column:
    """Whether op11_merkle changes a row before it checks its proof."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0


def _merkle_sql(levels: int = 8) -> str:
    """Trees of up to 8 ** levels leaves, level by level: a node of a finished tree is handed on as it is."""
    def field(c):
        return f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"

    def leaf(text):
        return f"sha256({field('doc_id')} || {field('source')} || {field('lang')} || {field('n_chars')} || {field(text)})"

    def tree(name, source):
        steps = [f"{name}0 AS ({source})"]
        for i in range(levels):
            steps.append(f"""{name}{i + 1} AS (SELECT g, up AS r, ceil(n / 8.0)::BIGINT AS n, CASE WHEN n > 1 THEN sha256(string_agg(d, '' ORDER BY r)) ELSE any_value(d) END AS d
              FROM (SELECT *, r // 8 AS up FROM {name}{i}) GROUP BY g, up, n)""")
            steps.append(f"{name}run{i} AS (SELECT g, r // 8 AS up, list(d ORDER BY r) AS run FROM {name}{i} WHERE n > 1 GROUP BY 1, 2)")
        return steps

    def climb(name, start, runs, group):
        steps, before = [], start
        for i in range(levels):
            steps.append(f"""{name}{i} AS (SELECT b.* REPLACE (CASE WHEN run IS NULL THEN now ELSE sha256(array_to_string(list_transform(run, lambda x, k: CASE WHEN k - 1 = place % 8 THEN now ELSE x END), '')) END AS now,
              CASE WHEN run IS NULL THEN proof ELSE proof || array_to_string(list_filter(run, lambda x, k: k - 1 <> place % 8), '') END AS proof,
              place // 8 AS place) FROM {before} b LEFT JOIN {runs}{i} t ON t.g = b.{group} AND t.up = b.place // 8)""")
            before = f"{name}{i}"
        return steps, before
    low, after_low = climb("low", "start", "treerun", "g")
    high, after_high = climb("high", "between", "toprun", "top")
    bits = "list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [256 + ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0]))), " \
           "lambda a, b: CASE WHEN b >= 256 THEN xor(a, b - 256) ELSE xor(a >> 1, 3988292384 * (a & 1)) END)"
    return f"""WITH d AS (SELECT doc_id, lang, {leaf('text')} AS leaf, {leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS lower_leaf,
        xor({bits}, 4294967295) % 3 = 0 AS tampered FROM documents),
      l AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r,
        count(*) OVER (PARTITION BY lang) AS n FROM d),
      {", ".join(tree("tree", "SELECT g, r, n, leaf AS d FROM l"))},
      {", ".join(tree("top", f"SELECT 0 AS g, g AS r, count(*) OVER () AS n, d FROM tree{levels}"))},
      start AS (SELECT doc_id, leaf, g, 0 AS top, r AS place, CASE WHEN tampered THEN lower_leaf ELSE leaf END AS now, '' AS proof FROM l),
      {", ".join(low)}, between AS (SELECT * REPLACE (g AS place) FROM {after_low}), {", ".join(high)}
      SELECT doc_id, leaf, t.d AS subroot, p.d AS root, sha256(proof) AS proof_sha256, now AS folded_root, now = p.d AS verified
      FROM {after_high} h JOIN tree{levels} t ON t.g = h.g CROSS JOIN top{levels} p"""


@query(_merkle_sql())
def op11_merkle(spark, sf_dir):
    """All documents as leaves, proofs by descent, and every proof checked against a row that may be changed."""
    docs = table(spark, sf_dir, "documents")
    capitals, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    shown = F.when(tampered(), merkle.leaf_of(text=F.translate("text", capitals, small))).otherwise(merkle.leaf_of())
    proofs = merkle.manifest(docs.select("doc_id", "lang", merkle.leaf_of().alias("leaf"), shown.alias("shown")), carried=("shown",))
    folded = merkle.folded(F.col("shown"), F.col("upwards"))
    return proofs.select("doc_id", "leaf", "subroot", "root", merkle.digest(merkle.siblings(F.col("upwards"))).alias("proof_sha256"),
                         folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


@query(f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS shingle FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM d WHERE len(w) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
    pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    edge AS (SELECT x, y FROM pair JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
    reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, e.y FROM reach r JOIN edge e ON e.x = r.y)
    SELECT x AS doc_id, coalesce(max(n), 0)::BIGINT AS n_shingles, min(y) AS component_id, x = min(y) AS kept FROM reach LEFT JOIN n ON n.doc_id = x GROUP BY x""")
def op12_minhash(spark, sf_dir):
    found = minhash.groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


@query()
def op13_whitening(spark, sf_dir):
    rows = whitening.whole_numbers(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return whitening.apply(rows, "vec_id", whitening.fit(rows))
