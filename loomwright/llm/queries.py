"""All queries of this folder. Importing a module registers its query."""

from loomwright.llm import (  # noqa: F401
    conversations, fingerprints, language_model, licenses, minhash, packing, quality,
    retrieval_packing, revisits, runs, secrets, segmentation, urls,
)
from loomwright.llm.common import ORACLES, QUERIES  # noqa: F401
