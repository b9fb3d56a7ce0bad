"""Operations of a large-scale training-data pipeline, one module each.

Nothing outside this subpackage imports it; ``queries.py`` registers its queries.
"""
