"""Spark-native preparation and analysis of chat data for draft models.

Everything is a DataFrame in and a DataFrame out, or a Column in and a Column
out.  ``functions`` holds column helpers, ``sources`` readers, normalisers and
sinks, ``operators`` the DataFrame operators, ``plans`` compositions of them
and ``streaming`` the incremental forms.
"""
