"""DuckDB twins of the registered queries: importing the SQL modules fills ``SQL``."""

from textlm.plans import sql_embed, sql_encode, sql_eval, sql_lexicon, sql_lm, sql_vectors  # noqa: F401
from textlm.plans.sql_lm import SQL

__all__ = ["SQL"]
