"""All queries; importing the package registers them."""

from . import features, files, histories, models, samples, summaries, tokenised  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
