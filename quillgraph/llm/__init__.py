"""Operators for preparing training text: tokenising, packing, filtering, extraction and de-duplication.

Nothing outside this subpackage imports it; it can be removed without effect on the rest of the library.
"""
