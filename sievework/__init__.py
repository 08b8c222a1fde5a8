"""Text-dataset preparation and classifier auditing as DataFrame operators."""
