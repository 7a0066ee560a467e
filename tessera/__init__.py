"""tessera: a PySpark-native engine for measuring and governing text corpora.

Every operator is a ``DataFrame -> DataFrame`` function; configuration (lexicons,
profiles, rules, gates) enters as small tables.  Nothing here imports
``tessera.llm``, which is an optional subpackage.
"""
