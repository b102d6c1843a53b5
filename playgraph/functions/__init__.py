"""playgraph.functions"""
