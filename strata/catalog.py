"""All registered queries of the library, and their SQL."""

from strata import more_queries, queries

#: Importing more_queries has put its queries beside those of queries.
MODULES = (queries, more_queries)
QUERIES, SQL = queries.QUERIES, queries.SQL
