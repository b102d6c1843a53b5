"""playgraph.operators"""
