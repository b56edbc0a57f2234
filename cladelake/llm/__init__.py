"""Operators for preparing training text at corpus scale.

Nothing else in :mod:`cladelake` imports this subpackage.
"""
