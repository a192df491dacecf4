"""Imports every family so that its queries are registered."""

from . import (annotations, catalog, documents, exports, labelling, rules, sources, tables,  # noqa: F401
               vectors)
