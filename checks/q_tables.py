"""Filters, lookups, top-k and table maintenance."""

from pyspark.sql import functions as F

from checks.base import (
    TX, TXC, TX_RECURRING, register, table, tx, tx_recurring, txc,
)
from tallyframe.operators import categories as cats
from tallyframe.operators import search
from tallyframe.operators import tables as ops
from tallyframe.session import new_path

COLS = "id, transaction_date, description, amount, category"
KEEP = COLS.split(", ")
BOUNDS = dict(start="1996-01-01", end="1999-12-31", category="food", min_amount=-300000.0,
              max_amount=-50000.0)
WHERE = """transaction_date >= TIMESTAMP '1996-01-01' AND transaction_date <= TIMESTAMP '1999-12-31'
    AND category = 'food' AND amount >= -300000 AND amount <= -50000"""
STAMP = "2024-01-01 00:00:00"


def _now():
    return F.lit(STAMP).cast("timestamp")


register(
    "list_transactions",
    lambda s, d: ops.list_transactions(txc(s, d), skip=10, limit=100, **BOUNDS).select(*KEEP),
    f"""WITH {TXC} SELECT {COLS} FROM txc WHERE {WHERE}
        ORDER BY transaction_date DESC, id LIMIT 100 OFFSET 10""",
)
register(
    "count_transactions",
    lambda s, d: ops.count_transactions(txc(s, d), **BOUNDS),
    f"WITH {TXC} SELECT count(*) AS total FROM txc WHERE {WHERE}",
)
register(
    "get_transaction",
    lambda s, d: ops.get_transaction(tx(s, d), "77").select(*KEEP),
    f"WITH {TX} SELECT {COLS} FROM tx WHERE id = '77'",
)
register(
    "append_transactions",
    lambda s, d: ops.append_transactions(tx(s, d), tx_recurring(s, d).drop("id"), _now())
    .groupBy("category", "created_at").agg(
        F.count("*").alias("n"), F.count("id").alias("ids"), F.sum("amount").alias("total")
    ),
    f"""WITH {TX}, {TX_RECURRING} SELECT category, created_at, count(*) AS n, count(id) AS ids,
        sum(amount) AS total FROM (
        SELECT id, category, amount, CAST(NULL AS TIMESTAMP) AS created_at FROM tx UNION ALL
        SELECT id, category, amount, TIMESTAMP '{STAMP}' FROM tx_recurring) AS rows GROUP BY 1, 2""",
    "total",
)


def _patches(s, d):
    key = F.col("id").cast("bigint")
    return tx(s, d).filter(key % 10 == 0).select(
        "id",
        F.concat(F.lit("PATCHED "), "description").alias("description"),
        F.when(key % 20 == 0, F.col("amount") * 2).alias("amount"),
    )


register(
    "update_transactions",
    lambda s, d: ops.update_transactions(tx(s, d), _patches(s, d), _now()).select(
        *KEEP, "updated_at"
    ),
    f"""WITH {TX} SELECT id, transaction_date, category,
        CASE WHEN CAST(id AS BIGINT) % 10 = 0 THEN 'PATCHED ' ELSE '' END || description
          AS description,
        CASE WHEN CAST(id AS BIGINT) % 20 = 0 THEN amount * 2 ELSE amount END AS amount,
        CASE WHEN CAST(id AS BIGINT) % 10 = 0 THEN TIMESTAMP '{STAMP}' END AS updated_at
        FROM tx""",
)
register(
    "delete_transactions",
    lambda s, d: ops.delete_transactions(
        tx(s, d), tx(s, d).filter("description = 'TRANSFER'")
    ).select(*KEEP),
    f"WITH {TX} SELECT {COLS} FROM tx WHERE description <> 'TRANSFER'",
)
register(
    "search_transactions",
    lambda s, d: ops.search_transactions(txc(s, d), "Rest", "1996-01-01", "2000-12-31").select(
        *KEEP
    ),
    f"""WITH {TXC} SELECT {COLS} FROM txc WHERE (contains(lower(description), 'rest')
        OR contains(lower(category), 'rest')) AND transaction_date >= TIMESTAMP '1996-01-01'
        AND transaction_date <= TIMESTAMP '2000-12-31'""",
)
register(
    "similar_transactions",
    lambda s, d: ops.similar_transactions(tx(s, d), "gas").select(*KEEP),
    f"""WITH {TX} SELECT {COLS} FROM tx WHERE contains(lower(description), 'gas')
        ORDER BY transaction_date DESC, id LIMIT 3""",
)
register(
    "recent_transactions",
    lambda s, d: ops.recent_transactions(tx(s, d)).select(*KEEP),
    f"WITH {TX} SELECT {COLS} FROM tx ORDER BY transaction_date DESC, id LIMIT 5",
)
register(
    "distinct_categories",
    lambda s, d: ops.distinct_categories(tx(s, d)),
    f"WITH {TX} SELECT DISTINCT category FROM tx WHERE category <> ''",
)
register(
    "category_counts",
    lambda s, d: ops.category_counts(tx(s, d)),
    f"""WITH {TX} SELECT category, count(*) AS n FROM tx WHERE category IS NOT NULL GROUP BY 1""",
)
register(
    "categories_table",
    lambda s, d: cats.categories_table(s).join(
        txc(s, d).groupBy(F.col("category").alias("name")).agg(F.count("*").alias("n")),
        "name", "left",
    ).select("name", "description", "color", "icon", "n"),
    f"""WITH {TXC}, names AS (SELECT * FROM (VALUES {', '.join(
        "('" + "', '".join(row) + "')" for row in cats.DEFAULT_CATEGORIES)})
        AS v(name, description, color, icon))
        SELECT name, description, color, icon, n FROM names LEFT JOIN (
        SELECT category AS name, count(*) AS n FROM txc GROUP BY 1) AS c USING (name)""",
)


def category_dim(s, d):
    """A tree from the tables: regions, their nations, their customers, and the built-in names."""
    none = F.lit(None).cast("string")

    def rows(df, name, parent):
        return df.select(
            F.col(name).alias("name"), none.alias("description"), none.alias("color"),
            none.alias("icon"), parent.alias("parent_category"),
        )

    region, nation = table(s, d, "region"), table(s, d, "nation")
    customer = table(s, d, "customer")
    of_region = nation.join(region, nation.n_regionkey == region.r_regionkey)
    of_nation = customer.join(nation, customer.c_nationkey == nation.n_nationkey)
    tree = rows(region, "r_name", F.lit("")).unionByName(
        rows(of_region, "n_name", F.col("r_name"))
    )
    return tree.unionByName(rows(of_nation, "c_name", F.col("n_name"))).unionByName(
        cats.categories_table(s)
    )


_DIM = f"""dim AS (
  SELECT r_name AS name, NULL AS icon, '' AS parent_category FROM region
  UNION ALL SELECT n_name, NULL, r_name FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT c_name, NULL, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT * FROM (VALUES {', '.join(
      f"('{r[0]}', '{r[3]}', NULL)" for r in cats.DEFAULT_CATEGORIES)}) AS v)"""
_OUT = ("name", "icon", "parent_category")
register(
    "add_category",
    lambda s, d: cats.add_category(category_dim(s, d), "pets", icon="paw",
                                   parent_category="food").select(*_OUT),
    f"WITH {_DIM} SELECT * FROM dim UNION ALL SELECT 'pets', 'paw', 'food'",
)
register(
    "get_category",
    lambda s, d: cats.get_category(category_dim(s, d), "NATION_7").select(*_OUT),
    f"WITH {_DIM} SELECT * FROM dim WHERE name = 'NATION_7'",
)
register(
    "update_category",
    lambda s, d: cats.update_category(category_dim(s, d), "NATION_7", "Nation seven", icon="flag",
                                      parent_category="food").select(*_OUT),
    f"""WITH {_DIM} SELECT * FROM dim WHERE name <> 'NATION_7'
        UNION ALL SELECT 'Nation seven', 'flag', 'food'""",
)
register(
    "delete_category",
    lambda s, d: cats.delete_category(category_dim(s, d), "NATION_7").select(*_OUT),
    f"WITH {_DIM} SELECT * FROM dim WHERE name <> 'NATION_7'",
)
register(
    "category_hierarchy",
    lambda s, d: cats.category_hierarchy(category_dim(s, d)),
    f"""WITH RECURSIVE {_DIM}, tree AS (
          SELECT name AS root, name, parent_category, CAST(0 AS INTEGER) AS depth, name AS path
          FROM dim WHERE parent_category IS NULL OR parent_category = ''
          UNION ALL
          SELECT t.root, d.name, d.parent_category, t.depth + 1, t.path || '/' || d.name
          FROM dim AS d JOIN tree AS t ON d.parent_category = t.name)
        SELECT * FROM tree""",
)


def _indexed(s, df):
    path = new_path(s, "search")
    search.write_search_index(df, path, files=8)
    return path


def _search_documents(s, d):
    """Texts by four queries, one of them shorter than a gram."""
    docs = table(s, d, "documents").select(
        F.col("doc_id").alias("id"), F.col("text").alias("description"),
        F.col("source").alias("category"), F.lit("2024-01-01").cast("date").alias("transaction_date"))
    path = _indexed(s, docs)
    found = None
    for query in _QUERIES:
        rows = search.search_with_index(docs, path, query).select(F.lit(query).alias("query"), "id")
        found = rows if found is None else found.unionByName(rows)
    return found


_QUERIES = ("License", " the ", "qu", "no such words")
register(
    "search_with_index_documents", _search_documents,
    " UNION ALL ".join(f"""SELECT '{q}' AS query, doc_id AS id FROM documents
        WHERE contains(lower(text), '{q.lower()}') OR contains(lower(source), '{q.lower()}')"""
                       for q in _QUERIES),
)
register(
    "search_with_index",
    lambda s, d: search.search_with_index(
        tx(s, d), _indexed(s, tx(s, d)), "Station").select("id", "description", "category"),
    f"""WITH {TX} SELECT id, description, category FROM tx
        WHERE contains(lower(description), 'station') OR contains(lower(category), 'station')""",
)
register(
    "similar_with_index",
    lambda s, d: search.similar_with_index(
        tx(s, d), _indexed(s, tx(s, d)), "gas", 10).select("id", "description"),
    f"""WITH {TX} SELECT id, description FROM tx WHERE contains(lower(description), 'gas')
        ORDER BY transaction_date DESC, id LIMIT 10""",
)
