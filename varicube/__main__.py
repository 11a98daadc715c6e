from varicube.cli import main

main()
