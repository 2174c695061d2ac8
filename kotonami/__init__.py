"""kotonami: a PySpark-native engine for statistical kana-kanji text conversion.

Relational work is declared with the DataFrame and SQL API; Python runs only
where a built-in expression can't state the semantics (the Viterbi kernel,
finite-state tokenizers, a few string conversions), always over Arrow batches.
"""
