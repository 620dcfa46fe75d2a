"""Training-data operators over text and vectors; nothing else in the library imports this package.

``suite`` registers one query per operator; every operator module has its own general interface.
"""
