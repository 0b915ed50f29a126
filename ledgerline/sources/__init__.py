"""Readers: CSV files, file trees and listings, notices, catalog tables."""
