"""Training-data operators: text filtering, deduplication, extraction, encoding.

Nothing else in the library imports this subpackage.  Each module holds one
operator with its general interface; :mod:`slotwise.llm.queries` registers the
``opN_*`` queries that apply them to the driver tables.
"""
