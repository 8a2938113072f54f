"""Queries: the operators applied to whole tables, with the SQL that checks them."""

from litmine.plans import answers, documents, extraction, files, relational, scalar, search  # noqa: F401
