"""File formats as Python data sources, and the choice among them by URI."""
