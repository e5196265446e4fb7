"""Composable DataFrame operators of the billing model."""
