"""Training-data operators (language ID, decontamination, dedup, packing, scoring, chat).

Nothing else in the library imports this subpackage; general helpers come the other way.
"""
