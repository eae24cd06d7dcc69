"""playbill: integration of dated listings from many sources, as Spark jobs.

Vocabulary: a *film* is an entity, a *cinema* a location, a *showing* a dated fact that
links the two and carries a list of ``HH:MM`` times.
"""
