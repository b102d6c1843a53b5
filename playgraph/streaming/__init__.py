"""playgraph.streaming"""
