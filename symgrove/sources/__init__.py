"""Readers that turn file trees and tables into the ``files`` schema."""
