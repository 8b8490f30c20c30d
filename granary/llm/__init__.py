"""Operators for preparing language-model training data, one module each.

Nothing else in the package imports this subpackage; ``queries`` lists what
it registers with the driver's entry file.
"""
