"""skein.operators"""
