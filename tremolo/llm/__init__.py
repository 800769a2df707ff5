"""Training-data operators: dedup, filters, chat formatting, tokenisation, decontamination.

Nothing outside this subpackage imports it; deleting it leaves the rest of the library whole.
"""
