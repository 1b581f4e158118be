"""All queries of the subpackage, with the SQL that checks them where SQL can express them."""

from claimgrid.llm import chat, decontaminate, divergence, language, licenses, mixing, ngram_join, ngram_lm, prefix_trie, quality, substring, suffix, whitening  # noqa: F401
from claimgrid.llm.tables import ORACLES, QUERIES  # noqa: F401
