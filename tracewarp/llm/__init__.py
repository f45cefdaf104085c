"""Training-data operators over document, page, label and conversation tables.

Nothing else in the library imports this subpackage.
"""
