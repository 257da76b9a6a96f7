"""Keyword categories, text weights, the classifier and word counts."""

from pyspark.sql import functions as F

from checks.base import (
    TX, TXC, TX_MONEY, WORDS, register, sql_keywords, table, tx, tx_money, txc,
)
from tallyframe.functions.rules import RULE_SETS, rules_from_table
from tallyframe.functions.text import normalize_text
from tallyframe.operators import categorize as ops
from tallyframe.operators import classifier as ml
from tallyframe.session import new_path

register(
    "keyword_categorize",
    lambda s, d: txc(s, d).select("id", "description", "category"),
    f"WITH {TXC} SELECT id, description, category FROM txc",
)
for name, rules in RULE_SETS.items():
    register(
        f"keyword_categorize_{name}",
        lambda s, d, rules=rules: ops.keyword_categorize(tx(s, d), rules, overwrite=True)
        .groupBy("description", "category").agg(F.count("*").alias("n")),
        f"""WITH {TX} SELECT description, {sql_keywords('description', rules)} AS category,
        count(*) AS n FROM tx GROUP BY 1, 2""",
    )
register(
    "keyword_categorize_documents",
    lambda s, d: ops.keyword_categorize(
        table(s, d, "documents").withColumnRenamed("text", "description"), overwrite=True
    ).select("doc_id", "category"),
    f"SELECT doc_id, {sql_keywords('text')} AS category FROM documents",
)


def _rule_table(s, d):
    """Rules as data: the words of each category with their order, taken from the transactions."""
    pairs = txc(s, d).groupBy("category").agg(
        F.array_sort(F.collect_set(F.lower("description"))).alias("keywords")
    )
    order = F.create_map(*[x for i, n in enumerate(sorted(
        ("food", "transport", "shopping", "utilities", "entertainment", "health", "housing",
         "income", "other"))) for x in (F.lit(n), F.lit(i))])
    rules = rules_from_table(pairs.withColumn("seq", F.try_element_at(order, F.col("category"))))
    return ops.keyword_categorize(tx(s, d), rules, overwrite=True).groupBy("category").agg(
        F.count("*").alias("n")
    )


register(
    "keyword_categorize_rule_table",
    _rule_table,
    f"WITH {TXC} SELECT category, count(*) AS n FROM txc GROUP BY 1",
)

_SQL_NORMAL = r"""regexp_replace(trim(regexp_replace(regexp_replace(lower({0}),
    '[!-/:-@\[-`{{-~]', ' ', 'g'), '\s+', ' ', 'g')), '\b\d+\b', 'NUM', 'g')"""


def normal_sql(text):
    return _SQL_NORMAL.format(text)


register(
    "normalize_text",
    lambda s, d: tx_money(s, d).select(
        F.concat_ws(" #", "memo", "amt", "date").alias("raw")
    ).select("raw", normalize_text(F.col("raw")).alias("text")),
    f"""WITH {TX_MONEY} SELECT raw, {normal_sql('raw')} AS text FROM (
        SELECT memo || ' #' || amt || ' #' || "date" AS raw FROM tx_money) AS joined""",
)
register(
    "training_set",
    lambda s, d: ops.training_set(tx(s, d)).groupBy("text", "category", "label").agg(
        F.count("*").alias("n")
    ),
    f"""WITH {TX} SELECT {normal_sql('description')} AS text, category,
        CAST(dense_rank() OVER (ORDER BY category) - 1 AS DOUBLE) AS label, count(*) AS n
        FROM tx WHERE category IS NOT NULL GROUP BY 1, 2""",
)

_TERMS = r"""words AS (
  SELECT text, copies, regexp_extract_all(text, '\b\w\w+\b') AS w FROM (
    SELECT lower({text}) AS text, count(*) AS copies FROM {source} GROUP BY 1) AS texts),
terms AS (
  SELECT text, copies, term, count(*) AS tf FROM (
    SELECT text, copies, unnest(list_concat(w, list_transform(range(1, len(w)),
      lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM words) AS flat
  GROUP BY ALL),
vocabulary AS (
  SELECT term, CAST(sum(tf * copies) AS BIGINT) AS corpus_count,
         CAST(sum(copies) AS BIGINT) AS doc_count,
         ln((1 + (SELECT sum(copies) FROM words)) / (1 + sum(copies))) + 1 AS idf
  FROM terms GROUP BY term ORDER BY corpus_count DESC, term LIMIT 5000)"""
register(
    "tfidf_vocabulary",
    lambda s, d: ops.tfidf_vocabulary(tx(s, d)),
    f"WITH {TX}, {_TERMS.format(text='description', source='tx')} SELECT * FROM vocabulary",
    "10:idf",
)
# Whole texts: SQL's \w knows ASCII only, so its words are spelled as a Unicode class.
for name in ("tfidf_vocabulary_documents", "tfidf_vocabulary_documents_whole"):
    register(
        name,
        lambda s, d: ops.tfidf_vocabulary(table(s, d, "documents"), "text"),
        "WITH " + _TERMS.format(text="coalesce(text, '')", source="documents").replace(
            r"\b\w\w+\b", r"[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]{2,}") + " SELECT * FROM vocabulary",
        "10:idf",
    )
register(
    "tfidf_features",
    lambda s, d: ops.tfidf_features(tx(s, d)),
    f"""WITH {TX}, {_TERMS.format(text='description', source='tx')},
    raw AS (SELECT text, copies, term, tf * idf AS raw FROM terms JOIN vocabulary USING (term))
    SELECT text, copies, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY text)) AS weight
    FROM raw""",
    "10:weight",
)


def _train(s, d):
    return ml.train_categorizer(txc(s, d))


def _accuracy(s, d):
    model, accuracy = _train(s, d)
    return txc(s, d).agg(F.count("*").alias("n")).select("n", F.lit(accuracy).alias("accuracy"))


def _predicted(s, d):
    model, _ = _train(s, d)
    return ml.predict_categories(model, tx(s, d)).select("id", "prediction")


def _table(s, d):
    model, _ = _train(s, d)
    return ml.categorize_table(model, tx(s, d)).groupBy("category").agg(F.count("*").alias("n"))


def _missing(s, d):
    model, _ = _train(s, d)
    return ml.categorize_missing(model, tx(s, d)).groupBy("category").agg(
        F.count("*").alias("n"), F.sum(F.col("was_predicted").cast("int")).alias("predicted")
    )


def _reloaded(s, d):
    model, _ = _train(s, d)
    path = new_path(s, "categorizer")
    ml.save_categorizer(model, path)
    return ml.predict_categories(ml.load_categorizer(s, path), tx(s, d)).groupBy(
        "prediction"
    ).agg(F.count("*").alias("n"))


# The words of a description decide its category in this input, so a right model finds them all.
register("train_categorizer", _accuracy,
         "SELECT count(*) AS n, CAST(1 AS DOUBLE) AS accuracy FROM orders")
register("predict_categories", _predicted,
         f"WITH {TXC} SELECT id, {sql_keywords('description')} AS prediction FROM txc")
register("categorize_table", _table,
         f"WITH {TXC} SELECT category, count(*) AS n FROM txc GROUP BY 1")
register("categorize_missing", _missing,
         f"""WITH {TX} SELECT {sql_keywords('description')} AS category, count(*) AS n,
         count(*) FILTER (WHERE category IS NULL OR category = '') AS predicted
         FROM tx GROUP BY 1""")
register("save_load_categorizer", _reloaded,
         f"""WITH {TXC} SELECT category AS prediction, count(*) AS n FROM txc GROUP BY 1""")
register(
    "word_frequency",
    lambda s, d: ops.word_frequency(tx(s, d)),
    f"""WITH {TX} SELECT word, count(*) AS n FROM (
        SELECT unnest(regexp_split_to_array(lower(description), '\\s+')) AS word FROM tx) AS words
        WHERE word <> '' GROUP BY 1 ORDER BY n DESC, word LIMIT 20""",
)
register(
    "word_frequency_documents",
    lambda s, d: ops.word_frequency(table(s, d, "documents"), 50, "text"),
    """SELECT word, count(*) AS n FROM (
        SELECT unnest(regexp_split_to_array(lower(text), '\\s+')) AS word FROM documents) AS words
        WHERE word <> '' GROUP BY 1 ORDER BY n DESC, word LIMIT 50""",
)

_WORD = r"[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]{2,}"


def sql_weights(rows: str, train: str = "true", top: int = 5000) -> str:
    """CTEs from ``rows(id, text, ...)`` to ``vocabulary``, of the rows of ``train``, and ``weighed``:
    normalised weights of each row's terms."""
    return f"""split_rows AS (SELECT *, regexp_extract_all(text, '{_WORD}') AS w FROM {rows}),
    uses AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(list_concat(w,
      list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term
      FROM split_rows) AS flat GROUP BY ALL),
    vocabulary AS (SELECT term, sum(tf) AS used, ln((1 + (SELECT count(*) FROM {rows}
      WHERE {train})) / (1 + count(*))) + 1 AS idf FROM uses JOIN {rows} USING (id) WHERE {train}
      GROUP BY 1 ORDER BY used DESC, term LIMIT {top}),
    weighed AS (SELECT id, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY id))
      AS weight FROM uses JOIN vocabulary USING (term))"""


_DOCS = "docs AS (SELECT doc_id AS id, lower(coalesce(text, '')) AS text FROM documents)"
register(
    "tfidf_features_documents",
    lambda s, d: ops.document_features(table(s, d, "documents"), "doc_id", "text"),
    f"WITH {_DOCS}, {sql_weights('docs')} SELECT id AS doc_id, term, weight FROM weighed",
    "8:weight",
)


def _languages(s, d):
    """The language of a text as its category; a fifth of the documents is held out."""
    return table(s, d, "documents").select(
        F.col("doc_id").alias("id"), F.col("text").alias("description"),
        F.col("lang").alias("category"), (F.col("doc_id") % 5 == 0).alias("held"))


_LANGUAGES = f"""langs AS (SELECT doc_id AS id, lower({normal_sql('text')}) AS text, lang,
      doc_id % 5 = 0 AS held FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL),
    {sql_weights('langs', 'NOT held')},
    sums AS (SELECT lang, term, sum(weight) AS s FROM weighed JOIN langs USING (id)
      WHERE NOT held GROUP BY 1, 2),
    classes AS (SELECT lang, count(*) AS n, ln(count(*) + 1) - ln(sum(count(*)) OVER () + count(*)
      OVER ()) AS prior FROM langs WHERE NOT held GROUP BY 1),
    whole AS (SELECT lang, prior, ln(coalesce((SELECT sum(s) FROM sums WHERE sums.lang
      = classes.lang), 0) + (SELECT count(*) FROM vocabulary)) AS total FROM classes),
    scores AS (SELECT l.id, l.lang, c.lang AS guess, any_value(c.prior) + coalesce(sum(
        w.weight * (ln(coalesce(s.s, 0) + 1) - c.total)), 0) AS score
      FROM langs AS l CROSS JOIN whole AS c LEFT JOIN weighed AS w ON w.id = l.id
      LEFT JOIN sums AS s ON s.lang = c.lang AND s.term = w.term GROUP BY 1, 2, 3),
    guesses AS (SELECT id, any_value(lang) AS lang, max_by(guess, score) AS prediction
      FROM scores GROUP BY 1)"""


def _trained_languages(s, d):
    return ml.train_categorizer(_languages(s, d), split="held")


register(
    "train_categorizer_documents",
    lambda s, d: _languages(s, d).filter("held and category is not null").agg(
        F.count("description").alias("n")).withColumn(
        "accuracy", F.lit(_trained_languages(s, d)[1])),
    f"""WITH {_LANGUAGES} SELECT count(*) AS n,
        avg(CASE WHEN g.prediction = g.lang THEN 1.0 ELSE 0.0 END) AS accuracy
        FROM guesses AS g JOIN langs USING (id) WHERE held""",
    "accuracy",
)
register(
    "predict_categories_documents",
    lambda s, d: ml.predict_categories(
        _trained_languages(s, d)[0], _languages(s, d).filter(
            "description is not null and category is not null")).select("id", "prediction"),
    f"WITH {_LANGUAGES} SELECT id, prediction FROM guesses",
)
register(
    "table_categorize_documents",
    lambda s, d: ops.table_categorize(
        table(s, d, "documents").withColumnRenamed("text", "description"),
        s.createDataFrame([(i, c, list(w)) for i, (c, w) in enumerate(RULE_SETS["default"])],
                          "seq int, category string, keywords array<string>"), overwrite=True,
    ).select("doc_id", "category"),
    f"SELECT doc_id, {sql_keywords('text')} AS category FROM documents",
)
register(
    "table_categorize",
    # One rule for each customer, with the name and the account as keywords.
    lambda s, d: ops.table_categorize(
        table(s, d, "orders").select("o_orderkey", F.format_string(
            "Paid by CUSTOMER#%09d, order %d", "o_custkey", "o_orderkey").alias("description")),
        table(s, d, "customer").select(
            F.col("c_custkey").alias("seq"), F.col("c_mktsegment").alias("category"),
            F.array(F.lower("c_name"), F.concat(F.lit("account "), F.col("c_custkey")))
            .alias("keywords")),
    ).groupBy("category").agg(F.count("*").alias("n")),
    """SELECT coalesce(c_mktsegment, 'other') AS category, count(*) AS n FROM orders
       LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1""",
)
