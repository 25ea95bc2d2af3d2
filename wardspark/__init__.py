"""wardspark: text moderation as Spark DataFrame expressions.

``Engine`` is the entry point; the pieces it is made of live in ``functions``
(column expressions), ``sources`` (language packs, JSON lines), ``operators``
(matching, scoring, masking), ``plans`` (registered queries and their SQL) and
``streaming``.
"""

from wardspark.engine import Engine
from wardspark.sources.packs import Pack, PackLoader, builtin_packs

__all__ = ["Engine", "Pack", "PackLoader", "builtin_packs"]
