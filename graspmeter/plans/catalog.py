"""All registered queries and their check SQL."""

from __future__ import annotations

from functools import wraps

from graspmeter.plans import catalog_code, catalog_corpus, catalog_scale, catalog_scores, catalog_text
from graspmeter.session import configure

QUERIES = {}
ORACLES = {}


def _configured(fn):
    @wraps(fn)
    def run(spark, sf_dir):
        return fn(configure(spark), sf_dir)

    return run


for _part in (catalog_corpus, catalog_code, catalog_scores, catalog_text, catalog_scale):
    QUERIES.update({name: _configured(fn) for name, fn in _part.QUERIES.items()})
    ORACLES.update(_part.ORACLES)
