"""Training-data operators: token counts, codecs, filters, near-dedup, scans and scoring.

Nothing outside this package imports it; delete the folder and the rest of the
library keeps working. Every module holds one operator with its own general
interface; ``queries`` registers one thin query per operator.
"""
