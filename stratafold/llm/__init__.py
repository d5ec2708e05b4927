"""Training-data operators: ten corpus-scale building blocks and their queries.

Nothing else in the package imports this subpackage.
"""
