"""All registered queries: importing the plan modules fills ``REGISTRY``."""

from textlm.plans import q_embed, q_encode, q_eval, q_lexicon, q_lm, q_models, q_vectors  # noqa: F401  (registration)
from textlm.plans.registry import REGISTRY

__all__ = ["REGISTRY"]
